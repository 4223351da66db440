"""Benchmark decontamination with one FM-index for each shard of training texts.

A task reads its documents in shards of about a million indexed words.  Words that no test phrase
has are one symbol, runs of it are kept once, and equal texts of a shard are indexed once.  Every
window of a benchmark item is searched backwards at once; occurrences are located through sampled
positions and merged to spans of words.  No document is exchanged.

The benchmark is the query set and is broadcast in blocks whose size is checked; a larger one gives
more passes in the same stage, each adding to the spans found before.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.batches import bounded, in_row, out_of_row, row_schema
from corpuscope.llm.fm_index import FmIndex

WINDOW = 10
SHARD_WORDS = 1 << 20
MOST_BLOCK_BYTES = 32 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """A to Z in lower case; a word is a run of ASCII letters and digits and anything beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Phrases:
    """All windows of a block of items, as symbols: 0 ends a text, 1 is any other word."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words(text)]
            for at in range(max(len(symbols) - window, 0) + 1) if symbols else ():
                owners.setdefault(tuple(symbols[at:at + window]), set()).add(item or "")
        self.windows = [np.array(w) for w in owners]
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.owners = [sorted(x) for x in owners.values()]

    def find(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """(words, merged spans of hit words, items) of each text."""
        out: list = [None] * len(texts)
        place: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            place.setdefault(t or "", []).append(i)
        held, size = [], 0
        for text, rows in place.items():
            known = words(text)
            for i in rows:
                out[i] = (len(known), [], set())
            s = np.fromiter(map(self.vocabulary.get, known, itertools.repeat(1)), np.int64, len(known))
            kept = np.flatnonzero((s != 1) | (np.r_[0, s[:-1]] != 1))
            held.append((rows, s[kept], kept))
            size += len(kept) + 1
            if size >= SHARD_WORDS:
                self._search(held, out)
                held, size = [], 0
        self._search(held, out)
        return out

    def _search(self, held, out) -> None:
        if not held or not self.windows:
            return
        sizes = np.array([len(s) + 1 for _, s, _ in held])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        index = FmIndex(np.concatenate([np.append(s, 0) for _, s, _ in held]), starts, len(self.vocabulary) + 2)
        phrase, position = index.search(self.windows)
        text = np.searchsorted(starts, position, "right") - 1
        order = np.lexsort((position, text))
        bounds = np.flatnonzero(np.r_[True, np.diff(text[order]) != 0]) if len(order) else []
        for chosen in np.split(order, bounds[1:]) if len(order) else []:
            t = text[chosen[0]]
            rows, _, kept = held[t]
            low = kept[position[chosen] - starts[t]]
            high = low + self.lengths[phrase[chosen]]
            spans = merged(zip(low.tolist(), high.tolist()))
            items = {x for p in np.unique(phrase[chosen]) for x in self.owners[p]}
            for i in rows:
                out[i] = (out[i][0], spans, items)


def merged(spans) -> list[tuple[int, int]]:
    """Spans that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, end = [], 0
    for low, high in spans:
        out.append(text[end:at[low][0]])
        end = at[high - 1][1]
    return "".join([*out, text[end:]])


def blocks(benchmark: DataFrame) -> list[list[tuple]]:
    """The items in blocks of at most MOST_BLOCK_BYTES of text, or of a single longer item."""
    out, size = [[]], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        more = len((row["text"] or "").encode())
        if out[-1] and size + more > MOST_BLOCK_BYTES:
            out.append([])
            size = 0
        out[-1].append((row["item_id"], row["text"]))
        size += more
    return out


_SCHEMA = "text string, n_words long, spans array<struct<low: int, high: int>>, items array<string>"


def _pass(docs: DataFrame, block: list, window: int, remove: bool) -> DataFrame:
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(block)
    span = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(sent.value, window)
        for held in shards(batches):
            table = pa.Table.from_batches(held).combine_chunks()
            texts = table.column("text").to_pylist()
            found = phrases.find(texts)
            total = [n for n, _, _ in found]
            if remove:
                changed = [i for i, f in enumerate(found) if f[1]]
                again = {i: found[i][1] for i in changed}
                while again:  # what a cut brings together is searched as well
                    for i, s in again.items():
                        texts[i] = without(texts[i], s)
                    more = phrases.find([texts[i] for i in again])
                    for i, (_, _, items) in zip(again, more):
                        found[i][2].update(items)
                    again = {i: s for i, (_, s, _) in zip(again, more) if s}
            spans = [merged([(x["low"], x["high"]) for x in old] + s) for old, (_, s, _) in zip(
                table.column("spans").to_pylist(), found)]
            items = [sorted({*old, *new}) for old, (_, _, new) in zip(table.column("items").to_pylist(), found)]
            done = pa.table([
                table.column("row"), pa.array(texts, pa.string()), pa.array(total, pa.int64()),
                pa.array([[{"low": a, "high": b} for a, b in s] for s in spans], span), pa.array(items, pa.list_(pa.string())),
            ], names=["row", "text", "n_words", "spans", "items"])
            yield from done.to_batches(max_chunksize=2048)

    return docs.mapInArrow(search, row_schema(docs, _SCHEMA))


def shards(batches, most_bytes: int = 16 << 20):
    """Batches together, up to a size of text; one long text may be more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.names.index("text")).nbytes
        if size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: bool = False) -> DataFrame:
    """The columns of ``docs`` with n_words, spans and items; with ``remove``, texts without the spans.

    A window is ``window`` words in a row of an item; an item of fewer words, but not none, is one
    window.  spans are merged word ranges (low to high - 1) of the given text that occurrences cover,
    items the sorted ids of items with an occurring window.  With ``remove``, the text that is left
    is searched again until nothing is found; spans then are those of the first search.
    NULL and empty texts have no words and stay as they are; a NULL item_id counts as ''; repeated
    rows are each marked; columns of ``docs`` named like the three new ones are replaced; an empty
    benchmark marks nothing.
    """
    new = ("n_words", "spans", "items")
    found = bounded(docs).select(
        in_row(docs, "text", *new), "text", F.lit(0).cast("long").alias("n_words"),
        F.expr("CAST(array() AS array<struct<low: int, high: int>>)").alias("spans"),
        F.expr("CAST(array() AS array<string>)").alias("items"))
    for block in blocks(benchmark):
        found = _pass(found, block, window, remove)
    return found.select(*out_of_row(docs, *new), *new)
