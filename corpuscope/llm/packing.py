"""Packing documents into training sequences by minimum bin slack.

A document's ids are cut at every full window; what remains of it is one piece shorter than a
window.  Only the number of pieces of each length matters for how they fit together, so the plan
is made from that histogram (at most ``window`` counts, however many documents there are): take
the longest remaining length, find by subset-sum dynamic programming over a bitset the multiset of
remaining lengths that fills its window closest to capacity, read the counts back from the steps,
and use that pattern as often as the counts allow.  Spark then ranks the pieces of each length and
gives each its sequence and offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.batches import bounded
from corpuscope.llm.tokens import encoder
from corpuscope.sources.shared import stored

WINDOW = 2048
SLICES = 512  # pieces of one length are ranked in so many parts

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


@dataclass(frozen=True)
class Vocabulary:
    """Files of one vocabulary, at the same place on every machine."""
    tokenizer: str
    ranks: str
    pattern: str

    @classmethod
    def public(cls) -> Vocabulary:
        import public_tokenizers as p

        return cls(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def cut(docs: DataFrame, vocabulary: Vocabulary, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """piece_id, doc_id, start, length, doc_tokens, ids: every document's ids, with ``end_id`` last.

    ``docs`` needs doc_id and text.  NULL texts are empty and have the end id alone; rows that
    repeat are each cut; texts are taken whole.  Ids are little-endian unsigned 32-bit numbers.
    """
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                        ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.tokenizer, vocabulary.ranks, vocabulary.pattern).encode
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for at in range(0, len(ids), 4 * window):
                    part = ids[at:at + 4 * window]
                    rows.append((doc_id, at // 4, len(part) // 4, len(ids) // 4, part))
                    held += len(part)
                if held >= 8 << 20:  # bounded batches, also after very long texts
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES).withColumn(
        "piece_id", F.monotonically_increasing_id())


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is the largest up to ``room``."""
    reached, mask, steps = 1, (1 << room + 1) - 1, []
    for length in lengths:
        if length > room:
            continue
        left, unit = min(counts[length], room // length), 1
        while left:
            unit = min(unit, left)
            steps.append((length, unit, reached))
            reached |= reached << length * unit & mask
            left, unit = left - unit, unit * 2
        if reached >> room & 1:
            break
    total, taken = reached.bit_length() - 1, {}
    for length, unit, before in reversed(steps):
        if not before >> total & 1:
            total -= length * unit
            taken[length] = taken.get(length, 0) + unit
    return taken


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from_rank, to_rank, in_each, first_sequence, offset) of every pattern's lengths.

    Pieces of a length with ranks from from_rank up to to_rank lie ``in_each`` by ``in_each`` in the
    sequences from first_sequence on, next to each other from ``offset``.
    """
    counts = {k: n for k, n in histogram.items() if n}
    used, out, sequence = dict.fromkeys(counts, 0), [], 0
    lengths = sorted(counts, reverse=True)
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        pattern = best_fill(lengths, counts, window - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[k] // m for k, m in pattern.items())
        offset = 0
        for k, m in sorted(pattern.items(), reverse=True):
            out.append((k, used[k], used[k] + times * m, m, sequence, offset))
            used[k] += times * m
            counts[k] -= times * m
            offset += k * m
        sequence += times
        lengths = [k for k in lengths if counts[k]]
    return out


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (stored: they are read twice) with sequence_id and offset.

    Any columns beside piece_id and length stay; they must not be named slice, rank or like the two
    new ones.  No row is dropped; no pieces give no rows.
    """
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("piece_id"), F.lit(SLICES)))
    counts = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    # at most window x SLICES rows, whatever the input
    before = counts.select("length", "slice", (F.sum("n").over(
        Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(histogram, window) or [(0, 0, 0, 1, 0, 0)]
    patterns = pieces.sparkSession.createDataFrame(
        rows, "length long, low long, high long, in_each long, first_sequence long, first_offset long")
    ranked = sliced.withColumn("rank", F.row_number().over(
        Window.partitionBy("length", "slice").orderBy("piece_id")).cast("long") - 1)
    ranked = ranked.join(before, ["length", "slice"]).withColumn("rank", F.col("rank") + F.col("before"))
    # the plan has a few rows for each of at most ``window`` lengths
    placed = ranked.join(F.broadcast(patterns), "length").where("rank >= low AND rank < high")
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("in_each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (F.col("rank") - F.col("low")) % F.col("in_each") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, vocabulary: Vocabulary, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their ids, sequence and offset; see ``cut`` and ``place``."""
    return place(stored(cut(docs, vocabulary, window, end_id), "pieces"), window)


def padded_length(filled: Column, window: int = WINDOW) -> Column:
    """Length a sequence is padded to: the window, or none if it already is a power of two long."""
    return F.when(filled.bitwiseAND(filled - 1) == 0, filled).otherwise(F.lit(window))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, filled: the ids of each sequence in order; a group has at most a window of ids."""
    part = F.struct("offset", "ids")
    merged = F.transform(F.sort_array(F.collect_list(part)), lambda p: F.hex(p["ids"]))
    return packed.groupBy("sequence_id").agg(
        F.unhex(F.array_join(merged, "")).alias("ids"), F.sum("length").alias("filled"))
