"""Removal of repeated passages by sliding runs of sentences, and of words whatever the sentences.

A sentence ends at a word that ends with a full stop, exclamation or question mark, at a line end
or with the text.  From every sentence on, and up to every sentence, the shortest run of at least
SENTENCES sentences and WORDS words is hashed.  The same is done between anchors, which know no
sentences or lines: of each WINDOW words in a row, the one with the smallest hash is an anchor.
PASSAGE words that occur twice have the same anchors, the first among their first WINDOW words and
the last among their last, so they hold a run of anchors in both places.  Runs of all documents
meet by hash; of a run that occurs again, every occurrence but the first (smallest document, then
place) is removed.

Runs are taken in TURNS turns by their hash, so that one turn's are on disk at a time; each turn
reads the texts again.  Hashes are combined to their first and last occurrence inside each task;
only runs that a fixed-size filter takes for repeated are moved a second time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm import sketch
from corpuscope.llm.batches import bounded, in_row, out_of_row, row_schema
from corpuscope.llm.shingles import powers, text_chunks, word_hashes
from corpuscope.sources.shared import stored

SENTENCES = 1
WORDS = 25
WINDOW = 8  # a power of two
TURNS = 2
PASSAGE = WORDS + 3 * WINDOW - 2  # words that are found wherever they occur twice
_STOP = np.zeros(256, bool)
_STOP[[*b".!?"]] = True


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each sentence and the end, sentences before each row, start bytes)."""
    h, at, first = word_hashes(data, offsets)
    if not len(h):
        return h, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64), first
    blank_before = np.r_[first[1:], len(data)]
    line = np.r_[0, np.cumsum(data == 10)]
    shuts = line[blank_before] > line[first]  # a line end behind the word
    last = _last_bytes(data, first, blank_before)
    shuts |= _STOP[data[last]]
    shuts[at[1:][at[1:] > 0] - 1] = True
    starts = np.r_[0, np.flatnonzero(shuts) + 1]
    return h, starts, np.searchsorted(starts, at), first


def _last_bytes(data, first, until):
    """The last byte of each word that is no blank."""
    solid = ~((data == 32) | (data >= 9) & (data <= 13))
    place = np.maximum.accumulate(np.where(solid, np.arange(len(data)), 0))
    return place[until - 1]


def anchors(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the words with the smallest hash (of equal ones the last) of WINDOW words of a row."""
    if len(h) < WINDOW:
        return np.empty(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    least = (h * np.uint64(0x9E3779B97F4A7C15)) & ~low | low - (np.arange(len(h), dtype=np.uint64) & low)
    size = 1
    while size < WINDOW:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    start = np.arange(len(least))
    inside = start + WINDOW <= at[np.searchsorted(at, start, "right")]
    start, least = start[inside], least[inside]
    place = start + ((low - (least & low)).astype(np.int64) - start) % (1 << 24)
    return place[np.r_[True, place[1:] != place[:-1]]] if len(place) else place


def spans(data: np.ndarray, offsets: np.ndarray, passages: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each row, first word of each run, word behind it)."""
    h, starts, at, _ = sentences(data, offsets)
    count = len(starts) - 1
    first_word = starts[at]
    if count < 1:
        return h, first_word, np.empty(0, np.int64), np.empty(0, np.int64)
    row = np.searchsorted(at, np.arange(count), "right") - 1
    here = np.arange(count)
    end = np.maximum(np.searchsorted(starts, starts[:-1] + WORDS) - 1, here + SENTENCES - 1)
    ahead = end < at[row + 1]
    begin = np.minimum(np.searchsorted(starts, starts[1:] - WORDS, "right") - 1, here - SENTENCES + 1)
    behind = (begin >= at[row]) & (starts[1:] - WORDS >= 0)
    behind[behind] = end[begin[behind]] != here[behind]  # else it is there already
    low, high = np.r_[here[ahead], begin[behind]], np.r_[end[ahead], here[behind]]

    if not passages:
        return h, first_word, starts[low], starts[high + 1]
    place = anchors(h, first_word)
    row = np.searchsorted(first_word, place, "right")
    end, begin = np.searchsorted(place, place + WORDS), np.searchsorted(place, place - WORDS, "right") - 1
    ahead = end < len(place)
    ahead[ahead] = row[end[ahead]] == row[ahead]
    behind = begin >= 0
    behind[behind] = row[begin[behind]] == row[behind]
    behind[end[ahead]] = False  # it is there already
    return h, first_word, np.r_[starts[low], place[ahead], place[begin[behind]]], np.r_[starts[high + 1], place[end[ahead]], place[behind]]


def runs(data: np.ndarray, offsets: np.ndarray, passages: bool = True) -> tuple[np.ndarray, ...]:
    """(row, first word in its row, word behind it, two hashes) of every run, each run once."""
    h, first_word, low, high = spans(data, offsets, passages)
    if len(low):
        low, high = np.divmod(np.unique(low * (len(h) + 1) + high), len(h) + 1)
    row = np.searchsorted(first_word, low, "right") - 1
    up, down = powers(len(h) + 1)
    out = []
    for words in (h, (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)):
        total = np.r_[np.uint64(0), np.cumsum(words * up[: len(h)])]
        x = (total[high] - total[low]) * down[low]
        x ^= x >> np.uint64(32)
        out.append(x * np.uint64(0x9E3779B97F4A7C15))
    return row, low - first_word[row], high - first_word[row], *out


def _runs_of(docs: DataFrame, passages: bool, turn: int, bits: np.ndarray | None = None) -> DataFrame:
    """h1, h2, doc_id, version, low, high of all runs of a turn, or of those that the filter lets pass."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0), batch.column(1)
            for at, data, offsets in text_chunks(batch.column(2)):
                row, low, high, h1, h2 = runs(data, offsets, passages)
                keep = h1 % np.uint64(TURNS) == turn
                if sent.value is not None:
                    keep &= sketch.may_have(sent.value, h1)
                row, low, high, h1, h2 = (x[keep] for x in (row, low, high, h1, h2))
                where = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), ids.take(where), versions.take(where),
                    pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
                    names=["h1", "h2", "doc_id", "version", "low", "high"])

    return bounded(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text").mapInArrow(
        find, "h1 long, h2 long, doc_id long, version long, low int, high int")


def without_words(text: str, cuts: list[tuple[int, int]]) -> tuple[str, int]:
    """(text without the words of the cuts, sentences that lost words)."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    h, starts, _, first = sentences(data, np.array([0, len(data)]))
    gone = np.zeros(len(h), bool)
    for low, high in cuts:
        gone[low:high] = True
    begins = np.r_[0, first[1:], len(data)] if len(h) else np.array([0, len(data)])
    kept = np.repeat(~gone, np.diff(begins)) if len(h) else np.ones(len(data), bool)
    left = data[kept].tobytes().decode("utf-8", "replace")
    return left, int(np.add.reduceat(gone, starts[:-1], dtype=np.int64).astype(bool).sum()) if len(h) else 0


def remove_passages(docs: DataFrame) -> DataFrame:
    """``remove_repeats`` of sentence runs and of passages that have no whole sentences or other line breaks."""
    return remove_repeats(docs, passages=True)


def remove_repeats(docs: DataFrame, passages: bool = False) -> DataFrame:
    """The columns of ``docs`` with the text left, and n_removed, the sentences removed whole or in part.

    The first occurrence of a run is the one in the smallest (doc_id, hash of the text) and there
    the earliest; rows that repeat in both are one document and are treated alike.  NULL and empty
    texts stay; a NULL doc_id is the smallest; a column n_removed of ``docs`` is replaced; an empty
    table gives no rows.  Two different runs are taken for one with the odds of a 128-bit hash.
    """
    import pyarrow as pa

    place = F.struct("doc_id", "version", "low")
    found = []
    for turn in range(TURNS):
        repeated = stored(_runs_of(docs, passages, turn).groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                          .where(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first"), "repeated")
        again = _runs_of(docs, passages, turn, sketch.key_filter(repeated, "h1")).join(repeated, ["h1", "h2"]).where(
            ~place.eqNullSafe(F.col("first")))
        found.append(stored(again.select("doc_id", "version", "low", "high").distinct().groupBy("doc_id", "version").agg(
            F.collect_list(F.struct("low", "high")).alias("_spans")), "found"))
    cuts = reduce(DataFrame.union, found).groupBy("doc_id", "version").agg(
        F.flatten(F.collect_list("_spans")).alias("_spans"))  # no more runs than a text has

    keyed = docs.select(in_row(docs, "text", "n_removed"), "text", F.col("doc_id").cast("long").alias("_id"),
                        F.xxhash64("text").alias("_version"))
    joined = keyed.join(cuts, keyed["_id"].eqNullSafe(cuts["doc_id"]) & (keyed["_version"] == cuts["version"]), "left").select(
        "row", "text", "_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                text, n = text.as_py(), 0
                if text and spans.is_valid:
                    text, n = without_words(text, [(s["low"], s["high"]) for s in spans.as_py()])
                texts.append(text)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())],
                                             names=["row", "text", "n_removed"])

    done = joined.mapInArrow(cut, row_schema(joined, "text string, n_removed long"))
    return done.select(*out_of_row(docs, "n_removed"), "n_removed")
