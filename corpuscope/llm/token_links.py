"""Alignment of two tokenizers over a corpus by external spill counting.

Tasks align texts and collect records (pair of token ids, document, how often).  A full buffer is
sorted side-major (by B id, then A id, then document), cut by the low bits of the B id into radix
parts, and spilled as zstd runs: a head with each pair's count in the run, a body with its
documents.  Heads are merged by a k-way heap merge in levels, so that no task reads more than
``FAN_IN`` runs of one part; in the last level, where a B id's pairs follow one another, the
largest count of each B id is read off.  The bodies then stream past the counts of their part and
give back what each document gains.  A pair that nearly every document has is one number in a head
and one list in a run's body, and the bodies of a part are dealt out by run.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.batches import bounded
from corpuscope.llm.token_units import MOST_KEPT, Pair, aligner, units_of
from corpuscope.sources.shared import stored

RADIX = 6  # low bits of a B id that make its part
SPILL = 1 << 21  # links in a buffer before it is spilled
FAN_IN = 32  # runs merged, or streamed past one table, in a task's group
BLOCK = 1 << 14  # pairs of a run that the merge holds at once
ID_BITS, DOC_BITS = 20, 20

RUNS = ("run long, number int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "part int, head binary, body binary")


def _pack(*columns: np.ndarray) -> bytes:
    """Whole numbers that are not negative, each column by bytes of like weight."""
    import zstandard

    out = []
    for c in columns:
        c = np.ascontiguousarray(c, np.int64)
        width = max(1, (int(c.max(initial=0)).bit_length() + 7) // 8)
        out += len(c).to_bytes(8, "little"), bytes([width]), c.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        n, width = int.from_bytes(data[at:at + 8], "little"), data[at + 8]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(wide.view(np.int64).ravel())
        at += 9 + n * width
    return out


def _radix_first(keys: np.ndarray) -> np.ndarray:
    """Keys b << ID_BITS | a with the low bits of b in front: parts follow one another, side-major within."""
    b, a = keys >> ID_BITS, keys & (1 << ID_BITS) - 1
    return (b & (1 << RADIX) - 1) << 2 * ID_BITS - RADIX | b >> RADIX << ID_BITS | a


def _key_back(keys: np.ndarray) -> np.ndarray:
    low, high = keys >> 2 * ID_BITS - RADIX, keys >> ID_BITS & (1 << ID_BITS - RADIX) - 1
    return (high << RADIX | low) << ID_BITS | keys & (1 << ID_BITS) - 1


def _runs(links: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """part, head, body of one spilled buffer."""
    records, times = np.unique(_radix_first(links) << DOC_BITS | numbers, return_counts=True)
    keys = records >> DOC_BITS
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, docs_of = keys[first], np.diff(first, append=len(keys))
    counts = np.add.reduceat(times, first)
    cuts = np.searchsorted(keys, np.arange(1, 1 << RADIX) << 2 * ID_BITS - RADIX)
    at = np.append(first, len(records))
    for part, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True)):
        if low < high:
            s, e = at[low], at[high]
            documents = records[s:e] & (1 << DOC_BITS) - 1
            steps = np.diff(documents, prepend=0)
            steps[first[low:high] - s] = documents[first[low:high] - s]
            yield part, _pack(np.diff(keys[low:high], prepend=0), counts[low:high]), _pack(docs_of[low:high], steps, times[s:e])


def _batch(schema, **columns):
    import pyarrow as pa

    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def spilled(docs: DataFrame, pair: Pair, buffer: int = SPILL) -> DataFrame:
    """A row for each document (run, number, counts, digest of its groups) and for each run and part (head, body).

    ``docs`` needs doc_id and text; NULL and empty texts, and texts whose tokens do not give their
    bytes back, have no tokens; texts are taken whole; rows that repeat are each aligned.
    """
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, RUNS.split(", "))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = aligner(pair)
        run = TaskContext.get().partitionId() << 32
        rows, links, numbers, held = [], [], [], 0

        def spill():
            if held:
                done = list(_runs(np.concatenate(links), np.concatenate(numbers)))
                yield _batch(schema, run=[run] * len(done), part=[p for p, _, _ in done],
                             head=[h for _, h, _ in done], body=[b for _, _, b in done])
            named = dict(zip(schema.names[1:8], zip(*rows, strict=True), strict=True))
            yield _batch(schema, run=[run] * len(rows), **named)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                units = units_of(text.as_py() or "") if text.as_py() else []
                if len(find) > MOST_KEPT:
                    find.restart()
                which = np.fromiter(map(find.__getitem__, units), np.int64, len(units))
                find.learn()
                shown = [find.groups[k] for k in which]
                if not units or None in shown:
                    rows.append((len(rows), doc_id, 0, 0, 0, 0, ""))
                else:
                    size = find.ends[which + 1] - find.ends[which]
                    n = int(size.sum())
                    places = np.repeat(find.ends[which] - np.cumsum(size) + size, size) + np.arange(n)
                    links.append(find.links[places])
                    numbers.append(np.full(n, len(rows), np.int64))
                    held += n
                    rows.append((len(rows), doc_id, *map(int, find.counts[which].sum(0)), n,
                                 hashlib.sha256(";".join(shown).encode()).hexdigest()))
                if held >= buffer or len(rows) == 1 << DOC_BITS:
                    yield from spill()
                    run, rows, links, numbers, held = run + 1, [], [], [], 0
        if rows:
            yield from spill()

    return stored(bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(work, RUNS), "runs")


def merge(heads: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted pairs and their summed counts: the heap knows which run's block ends first."""
    at = [0] * len(heads)
    end = lambda k: int(heads[k][0][min(at[k] + BLOCK, len(heads[k][0])) - 1])
    heap = [(end(k), k) for k in range(len(heads)) if len(heads[k][0])]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        keys, counts = [], []
        for _, k in heap:  # whatever any run has up to here is complete
            to = at[k] + int(np.searchsorted(heads[k][0][at[k]:at[k] + BLOCK], bound, "right"))
            keys.append(heads[k][0][at[k]:to])
            counts.append(heads[k][1][at[k]:to])
            at[k] = to
        while heap and heap[0][0] == bound:
            _, k = heapq.heappop(heap)
            if at[k] < len(heads[k][0]):
                heapq.heappush(heap, (end(k), k))
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        yield found, np.bincount(where, np.concatenate(counts), len(found)).astype(np.int64)


def _merged(heads) -> tuple[np.ndarray, np.ndarray]:
    parts = list(merge([(np.cumsum(k), c) for k, c in map(_unpack, heads)]))
    return np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])


def counted(runs: DataFrame) -> DataFrame:
    """part, table: the pairs of each part in side-major order with count and whether it is their B id's largest."""
    import pyarrow as pa

    heads = runs.where("part IS NOT NULL").select("part", F.xxhash64("run").alias("turn"), "head")
    most = runs.where("part IS NOT NULL").groupBy("part").count().agg(F.max("count")).first()[0] or 0
    schema = pa.schema([("part", pa.int32()), ("turn", pa.int64()), ("head", pa.binary())])

    def level(rows: pa.Table) -> pa.Table:
        keys, counts = _merged(rows["head"].to_pylist())
        turn = rows["turn"][0].as_py()
        return pa.Table.from_batches([_batch(schema, part=[rows["part"][0].as_py()], turn=[turn], head=[_pack(np.diff(keys, prepend=0), counts)])])

    def last(rows: pa.Table) -> pa.Table:
        keys, counts = _merged(rows["head"].to_pylist())
        first = np.flatnonzero(np.diff(keys >> ID_BITS, prepend=-1))
        best = np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(keys)))
        return pa.table({"part": rows["part"].slice(0, 1), "table": pa.array([_pack(np.diff(keys, prepend=0), counts, counts == best)], pa.binary())})

    while most > FAN_IN:
        most = -(-most // FAN_IN)
        heads = stored(heads.groupBy("part", F.pmod("turn", F.lit(most)).alias("group")).applyInArrow(
            lambda rows: level(rows), "part int, turn long, head binary"), "heads")
    return stored(heads.groupBy("part").applyInArrow(last, "part int, table binary"), "tables")


def pairs(tables: DataFrame) -> DataFrame:
    """a_id, b_id, n_links, best: the corpus-wide count of each linked pair of ids."""
    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            for table in batch.column(0).to_pylist():
                steps, counts, best = _unpack(table)
                keys = _key_back(np.cumsum(steps))
                yield pa.RecordBatch.from_arrays([pa.array(keys & (1 << ID_BITS) - 1), pa.array(keys >> ID_BITS), pa.array(counts),
                                                  pa.array(best.astype(bool))], names=["a_id", "b_id", "n_links", "best"])

    return tables.select("table").mapInArrow(rows, "a_id long, b_id long, n_links long, best boolean")


def given_back(runs: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, its counts, n_best, count_sum and groups_sha256, for each document."""
    import pyarrow as pa

    n_runs = runs.agg(F.count_distinct("run")).first()[0]
    turns = max(1, -(-n_runs // FAN_IN))
    turn = F.pmod(F.xxhash64("run"), F.lit(turns))
    bodies = runs.where("part IS NOT NULL").select("run", "part", turn.alias("turn"), "head", "body")
    dealt = tables.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))))

    def stream(bodies: pa.Table, tables: pa.Table) -> pa.Table:
        out = []
        if bodies.num_rows:
            steps, counts, best = _unpack(tables["table"][0].as_py())
            keys = np.cumsum(steps)
            for head, body in zip(bodies["head"], bodies["body"], strict=True):
                here = np.searchsorted(keys, np.cumsum(_unpack(head.as_py())[0]))
                docs_of, steps, times = _unpack(body.as_py())
                begin = np.cumsum(docs_of) - docs_of
                total = np.cumsum(steps)
                documents = total - np.repeat(total[begin] - steps[begin], docs_of)
                gains = np.repeat(counts[here], docs_of) * times
                sums = np.zeros(int(documents.max()) + 1, np.int64)
                np.add.at(sums, documents, gains)
                bests = np.zeros_like(sums)
                np.add.at(bests, documents, np.repeat(best[here], docs_of) * times)
                out.append(_pack(sums, bests))
        return pa.table({"run": bodies["run"], "gains": pa.array(out, pa.binary())})

    gains = stored(bodies.groupBy("part", "turn").cogroup(dealt.groupBy("part", "turn")).applyInArrow(stream, "run long, gains binary"), "gains")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def add(documents: pa.Table, gains: pa.Table) -> pa.Table:
        numbers = documents["number"].to_numpy()
        sums, bests = np.zeros((2, int(numbers.max(initial=0)) + 1), np.int64)
        for data in gains["gains"].to_pylist():
            s, b = _unpack(data)
            sums[:len(s)] += s
            bests[:len(b)] += b
        more = {"n_best": pa.array(bests[numbers]), "count_sum": pa.array(sums[numbers])}
        return pa.table({c: more[c] if c in more else documents[c] for c in columns})

    documents = runs.where("number IS NOT NULL").select("run", "number", *[c for c in columns if c not in ("n_best", "count_sum")])
    return documents.groupBy("run").cogroup(gains.groupBy("run")).applyInArrow(
        add, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, pair: Pair, buffer: int = SPILL) -> tuple[DataFrame, DataFrame]:
    """Rows of documents and rows of pairs.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is the largest of
    their B id, ties included), count_sum (over links) and groups_sha256, one row for each row of
    ``docs``; without tokens zeros and an empty string.  Other columns of ``docs``, whatever
    their names, are not read; an empty table gives no rows.
    """
    runs = spilled(docs, pair, buffer)
    tables = counted(runs)
    return given_back(runs, tables), pairs(tables)
