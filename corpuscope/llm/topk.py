"""Exact top-k inner products by aggregation without random access.

Every block of candidates is indexed once: for each component its rows in the order of their value.
The lists are read one after another from both ends, all down to the same magnitude, then to a
smaller one, and so on; one reading serves a whole block of queries.  What has been read of a row
gives its score so far; a list it has not been met in can add or take at most the query's weight
times the present magnitude.  A query is done when few rows can still reach its k-th lower bound;
the final scores of those are then resolved.

Queries are a stated set against all rows, so blocks of queries meet blocks of candidates; a block
has a bounded number of rows and a cell of two blocks is one unit of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_BLOCK = 16_384
QUERY_BLOCK = 2_048
AT_ONCE = 128  # queries whose bounds are held at a time


def scaled(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


class SortedLists:
    """The sorted lists of a block, and what has been read of them so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        n, m = vectors.shape
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T
        self.values = np.take_along_axis(vectors.T, self.order, 1)
        self.most = int(np.abs(vectors).max(initial=0))
        # float32 holds integers up to 2^24 exactly, float64 up to 2^53
        self.kind = np.float32 if m * self.most**2 < 2**24 else np.float64
        self.read, self.unread = np.zeros((m, n), self.kind), np.ones((m, n), self.kind)
        self.low, self.high = np.zeros(m, np.int64), np.full(m, n, np.int64)

    def levels(self) -> list[int]:
        """Magnitudes to read down to: from the median, halved to 1, where all but zeros are read."""
        level, out = max(1, int(np.median(np.abs(self.vectors)))) if self.vectors.size else 1, []
        while level > 1:
            out.append(level)
            level //= 2
        return [*out, 1]

    def read_to(self, level: int) -> None:
        """Read every list from both ends as long as its values have at least this magnitude."""
        for d, (order, values) in enumerate(zip(self.order, self.values)):
            low, high = np.searchsorted(values, -level, "right"), np.searchsorted(values, level, "left")
            for a, b in ((self.low[d], low), (max(high, low), self.high[d])):
                rows = order[a:b]
                self.read[d, rows] = values[a:b]
                self.unread[d, rows] = 0
            self.low[d], self.high[d] = low, max(high, low)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, ids, scores): the k best rows but the query's own, ties to the smaller id."""
        n, waiting = len(self.ids), np.arange(len(queries))
        levels = self.levels()
        fits = len(queries) and self.vectors.shape[1] * self.most * int(np.abs(queries).max(initial=0)) < (
            2**24 if self.kind is np.float32 else 2**53)
        if n <= 4 * k or not fits:
            for q in waiting:
                yield q, *self._resolve(queries[q], np.arange(n), own[q], k)
            return
        for level in levels:
            self.read_to(level)
            left = []
            for at in range(0, len(waiting), AT_ONCE):
                some = waiting[at:at + AT_ONCE]
                weights = queries[some].astype(self.kind)
                score = weights @ self.read
                slack = np.abs(weights) @ self.unread * self.kind(level - 1)
                lower = score - slack
                lower[self.ids[None, :] == own[some, None]] = -np.inf
                threshold = np.partition(lower, n - k, axis=1)[:, n - k]
                able = score + slack >= threshold[:, None]
                for q, row in zip(some, able):
                    rows = np.flatnonzero(row)
                    if len(rows) <= max(8 * k, n // 64) or level == levels[-1]:
                        yield q, *self._resolve(queries[q], rows, own[q], k)
                    else:
                        left.append(q)
            waiting = np.array(left, np.int64)

    def _resolve(self, query: np.ndarray, rows: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[self.ids[rows] != own]
        scores = self.vectors[rows] @ query
        first = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[first]], scores[first]


def usable(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 64) -> DataFrame:
    """id, v: the integer vectors that take part, every row of an id."""
    x = F.col(vector_column)
    fine = x.isNotNull() & F.col(id_column).isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where(fine).select(F.col(id_column).cast("long").alias("id"), scaled(x, scale).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, id, score: the k best candidates of every query, best first, ties to the smaller id.

    ``vectors`` are ``usable`` ones (id, v); ``is_query`` tells the queries by id.  Every row is a
    candidate of all queries but those of its own id, so a repeated id may take several ranks; several
    rows of a query's id ask with the smallest of their vectors.  Vectors that are NULL or hold NULL
    or non-finite components take no part, shorter vectors count as ending in zeros; fewer candidates
    give fewer rows; scores are exact within 64 bits.
    """
    import pyarrow as pa

    size = vectors.agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q"), F.max(F.size("v")).alias("m")).first()
    blocks, query_blocks = -(-(size["n"] or 1) // CANDIDATE_BLOCK), -(-(size["q"] or 1) // QUERY_BLOCK)
    width = size["m"] or 1
    deal = lambda count, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = vectors.select("id", deal(blocks, 1).alias("block"), every(query_blocks).alias("queries"), F.lit(False).alias("asks"), "v")
    asks = vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v")).select("id", every(blocks).alias("block"), deal(query_blocks, 2).alias("queries"), F.lit(True).alias("asks"), "v")
    cells = rows.unionByName(asks).repartition("block", "queries").sortWithinPartitions("block", "queries")

    def matrix(column) -> np.ndarray:
        lengths = column.value_lengths().to_numpy()
        out = np.zeros((len(lengths), width), np.int64)
        out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
        return out

    def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ask = table.column("asks").combine_chunks()
        ids, v = table.column("id").combine_chunks().to_numpy(), matrix(table.column("v").combine_chunks())
        ask = ask.to_numpy(zero_copy_only=False)
        own = ids[ask]
        found = [(own[q], *best) for q, *best in SortedLists(ids[~ask], v[~ask]).top(v[ask], own, k)] if len(own) else []
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
                pa.array(np.concatenate([f[1] for f in found]).astype(np.int64)),
                pa.array(np.concatenate([f[2] for f in found]).astype(np.int64))], names=["query_id", "id", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            cell = batch.column(1).to_numpy().astype(np.int64) * query_blocks + batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                if cell[low] != key:
                    if held:
                        yield from answer(pa.Table.from_batches(held))
                    key, held = cell[low], []
                held.append(batch.slice(low, high - low))
        if held:
            yield from answer(pa.Table.from_batches(held))

    found = cells.mapInArrow(work, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
