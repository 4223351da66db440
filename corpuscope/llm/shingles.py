"""Hashed words of many texts at once, and sets of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.batches import bounded

WORDS = 5
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_MIX = [np.uint64(x) for x in (_BASE, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LETTER = np.random.default_rng(7).integers(1, 2**63, 256, np.uint64)  # one 64-bit number for each byte
_LETTER[65:91] = _LETTER[97:123]  # A to Z like a to z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_OTHER = np.ones(256, bool)  # separators of plain words: all but ASCII letters and digits and bytes beyond ASCII
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were needed so far."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(2 * n, b, np.uint64)]) for b in (_BASE, _INVERSE))
        return self.up, self.down


_POWERS = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base of all word hashes, and of its inverse."""
    return _POWERS.get(n)


def text_chunks(column, most_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of an Arrow string column, some rows at a time; NULL is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        until = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most_bytes, "right")) - 1)
        yield row, data[offsets[row]:offsets[until]], offsets[row:until + 1] - offsets[row]
        row = until


def word_hashes(data: np.ndarray, offsets: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, how many words lie before each row, and where each word starts.

    Words are separated by blanks (0x20, 0x09 to 0x0D), with ``plain`` by any ASCII character but
    letters and digits; A to Z count as a to z.  A word's hash is a
    polynomial in its bytes' numbers, read off two running sums.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), np.empty(0, np.int64)
    blank = (_OTHER if plain else _SPACE)[data]
    opens = ~blank
    opens[1:] &= blank[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    opens[begins] = ~blank[begins]  # a row's first byte
    shuts = ~blank
    shuts[:-1] &= blank[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    shuts[ends] = ~blank[ends]
    first, last = np.flatnonzero(opens), np.flatnonzero(shuts)
    up, down = _POWERS.get(n)
    total = np.cumsum(_LETTER[data] * up[:n])
    h = (total[last] - total[first] + _LETTER[data[first]] * up[first]) * down[first]
    h ^= h >> np.uint64(32)
    h *= _MIX[1]
    h ^= h >> np.uint64(29)
    return h, np.searchsorted(first, offsets), first


def _combined(h: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words."""
    count = len(h) - size + 1
    out = np.full(count, size, np.uint64)
    for k in range(size):
        out ^= out >> np.uint64(29)
        out *= _MIX[k % len(_MIX)]
        out += h[k:k + count]
    out ^= out >> np.uint64(32)
    out *= _MIX[0]
    out ^= out >> np.uint64(29)
    return out


def shingles_of(column, words: int = WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of some texts at a time: of each the sorted distinct hashes of its runs of
    ``words`` words, or of all its words together if there are fewer."""
    for row, data, offsets in text_chunks(column):
        h, at, _ = word_hashes(data, offsets)
        runs = _combined(h, words) if len(h) >= words else h[:0]
        sets = []
        for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
            if high - low >= words:
                s = np.sort(runs[low:high - words + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                sets.append(s[keep])
            else:
                sets.append(_combined(h[low:high], high - low) if high > low else h[:0])
        yield row, sets


def nodes_of(sets: list[np.ndarray]) -> np.ndarray:
    """A name for each set; 0 for an empty one."""
    return np.array([xxhash.xxh3_64_intdigest(s.data) if len(s) else 0 for s in sets], np.uint64).view(np.int64)


def over_sets(docs: DataFrame, work, schema: str, words: int = WORDS) -> DataFrame:
    """``work`` on the shingle sets of all texts, in the task that reads them.

    ``work`` gets an iterator of (doc ids as an Arrow array, nodes, sets) and yields record batches.
    A node names a set: texts with equal sets share it; without words it is 0.  Two different sets
    share a node, or two shingles a hash, with the odds of a 64-bit hash.
    """
    def hashed(batches):
        for batch in batches:
            for row, sets in shingles_of(batch.column(1), words):
                yield batch.column(0)[row:row + len(sets)], nodes_of(sets), sets

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda batches: work(hashed(batches)), schema)
