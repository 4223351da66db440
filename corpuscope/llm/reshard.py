"""Resharding that moves the fewest bytes.

Old shards supply their bytes, new shards take up to their capacity, and every byte that changes
its shard costs one: a minimum-cost flow over shards, solved from their sizes alone.  Each old shard
is a line of blocks (hash slices of its rows); a flow out of it is a stretch of that line, so whole
blocks move, and only the block in which a stretch ends is divided.  Sizes therefore differ by a few
rows.  Only files of shards that gain or lose rows are written.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.sources.shared import shared_folder

SLICES = 4096
FILE_BYTES = 64 << 20
LEAST_FILES = 4


def cheapest_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """How much goes from each supply to each capacity at the least total cost.

    Successive shortest paths on the residual graph; costs are not negative and capacities
    together hold the supplies.
    """
    n, m = len(supply), len(capacity)
    start, end = n + m, n + m + 1
    to, room, price, edges = [], [], [], [[] for _ in range(n + m + 2)]

    def link(a: int, b: int, size: int, each: int) -> None:
        for x, y, r, c in ((a, b, size, each), (b, a, 0, -each)):
            edges[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(c)

    for i, s in enumerate(supply):
        link(start, i, s, 0)
    first = len(to)
    for i in range(n):
        for j in range(m):
            link(i, n + j, supply[i], cost[i][j])
    for j, c in enumerate(capacity):
        link(n + j, end, c, 0)
    while True:
        best, via, queue, queued = {start: 0}, {}, deque([start]), {start}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in edges[a]:
                b = to[e]
                if room[e] and best[a] + price[e] < best.get(b, float("inf")):
                    best[b], via[b] = best[a] + price[e], e
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        if end not in via:
            break
        path, b = [], end
        while b != start:
            path.append(via[b])
            b = to[via[b] ^ 1]
        size = min(room[e] for e in path)
        for e in path:
            room[e] -= size
            room[e ^ 1] += size
    return [[room[first + 2 * (i * m + j) + 1] for j in range(m)] for i in range(n)]


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


class Plan:
    """Transfers between shards, and where every row of ``docs`` goes."""

    def __init__(self, docs: DataFrame, old: Column, shards: int, capacity: list[int] | None = None,
                 cost: list[list[int]] | None = None):
        """``docs`` needs doc_id and text, ``old`` gives the present shard (0 and up; NULL is 0).

        A row counts its text's UTF-8 bytes and 8; NULL texts have none.  Repeated rows each count.
        Capacities default to equal ones, costs to 1 for a byte that changes its shard.  Sizes of at
        most SLICES blocks per old shard come to the driver.
        """
        self.shards = shards
        self.rows = docs.select(
            "doc_id", "text", F.coalesce(old.cast("int"), F.lit(0)).alias("_old"),
            F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int").alias("_slice"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"))
        blocks = self.rows.groupBy("_old", "_slice").agg(F.sum("size").alias("bytes")).orderBy("_old", "_slice").collect()
        count = max([shards - 1, *(r["_old"] for r in blocks)]) + 1
        self.supply = [0] * count
        starts = []
        for r in blocks:
            starts.append((r["_old"], r["_slice"], self.supply[r["_old"]], r["bytes"]))
            self.supply[r["_old"]] += r["bytes"]
        capacity = capacity or equal_capacities(sum(self.supply), shards)
        cost = cost or [[int(i != j) for j in range(shards)] for i in range(count)]
        self.flow = cheapest_flow(self.supply, capacity, cost)
        stretches = []
        for i, row in enumerate(self.flow):
            at = 0
            for j in sorted(range(shards), key=lambda j: (j != i, j)):  # what stays comes first
                if row[j]:
                    stretches.append((i, j, float(at), float(at + row[j])))
                    at += row[j]
        spark = docs.sparkSession
        self.blocks = spark.createDataFrame(starts, "_old int, _slice int, _start long, _bytes long")
        self.stretches = spark.createDataFrame(stretches, "_old int, shard int, _low double, _high double")
        self.affected = sorted({k for i, row in enumerate(self.flow) for j, n in enumerate(row) if n and i != j for k in (i, j) if k < shards})
        self.files = max(LEAST_FILES, -(-max(capacity, default=0) // FILE_BYTES))

    @property
    def moved(self) -> int:
        return sum(n for i, row in enumerate(self.flow) for j, n in enumerate(row) if i != j)

    def placed(self) -> DataFrame:
        """doc_id, text, size, shard, file, slot of every row; slots of a shard run from 0 without gaps.

        Shards are found in the task that reads a row (both tables are bounded by the number of
        shards); one exchange by file then orders the rows of each file by doc_id and text.
        """
        share = (F.xxhash64("doc_id", F.lit(1)).bitwiseAND(F.lit(2**31 - 1)) + 0.5) / F.lit(2.0**31)
        # a row's place in its block follows a hash, so blocks are divided without an order
        at = self.rows.join(F.broadcast(self.blocks), ["_old", "_slice"]).withColumn(
            "_at", F.col("_start") + share * F.col("_bytes"))
        at = at.join(F.broadcast(self.stretches), "_old").where("_at >= _low AND _at < _high")
        at = at.select("doc_id", "text", "size", "shard", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(self.files)).cast("int").alias("file"))
        counts = at.groupBy("shard", "file").agg(F.count("*").alias("n")).collect()  # shards x files rows
        seen, starts = dict.fromkeys(range(self.shards), 0), []
        for r in sorted(counts):
            starts.append((r["shard"], r["file"], seen[r["shard"]]))
            seen[r["shard"]] += r["n"]
        before = self.rows.sparkSession.createDataFrame(starts, "shard int, file int, _before long")
        own = Window.partitionBy("shard", "file").orderBy("doc_id", "text")
        return at.withColumn("_rank", F.row_number().over(own)).join(F.broadcast(before), ["shard", "file"]).select(
            "doc_id", "text", "size", "shard", "file", (F.col("_before") + F.col("_rank") - 1).alias("slot"))

    def rewritten(self, folder: str | None = None) -> DataFrame:
        """All rows as they lie afterwards: files of affected shards are written to ``folder`` and read back."""
        spark, placed = self.rows.sparkSession, self.placed()
        folder = folder or shared_folder(spark, "shards")
        if not self.affected:
            return placed
        placed.where(F.col("shard").isin(self.affected)).write.option("compression", "zstd").partitionBy("shard").parquet(folder)
        kind = "doc_id {}, text string, size long, file int, slot long, shard int".format(placed.schema["doc_id"].dataType.simpleString())
        back = spark.read.schema(kind).parquet(folder)
        if len(self.affected) == self.shards:
            return back
        return back.unionByName(placed.where(~F.col("shard").isin(self.affected)))
