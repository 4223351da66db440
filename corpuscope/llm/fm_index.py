"""An FM-index over one shard's words: suffix order, wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 16


def suffix_order(s: np.ndarray, bits: int) -> np.ndarray:
    """Start positions of the suffixes of ``s`` in order; ``bits`` hold a symbol plus one.

    As many symbols as fit into 62 bits are compared at first; then ranks are doubled, each time
    only among suffixes that are still equal, so long repeats cost no more than their own length.
    """
    n, depth = len(s), max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(depth):
        key <<= bits
        key[: max(n - i, 0)] |= s[i:] + 1  # 0 is the end
    order = np.argsort(key)
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        at = np.flatnonzero(~(first & np.r_[first[1:], True]))
        if not at.size:
            return order
        pos = order[at]
        after = pos + depth
        inside = after < n
        key = rank[pos] * (n + 1)
        key[inside] += rank[after[inside]] + 1
        moved = np.argsort(key)
        key, pos = key[moved], pos[moved]
        starts = np.r_[True, key[1:] != key[:-1]]
        order[at], first[at] = pos, starts
        rank[pos] = np.maximum.accumulate(np.where(starts, at, 0))
        depth *= 2


class Ranks:
    """Wavelet tree, stored level by level: how often a symbol occurs before a position."""

    def __init__(self, s: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (s >> shift & 1).astype(bool)
            room = np.zeros((len(s) // 64 + 1) * 64, bool)
            room[: len(s)] = bit
            words = np.packbits(room, bitorder="little").view(np.uint64)
            before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]
            zeros = len(s) - int(bit.sum())
            self.levels.append((shift, words, before, zeros))
            s = np.concatenate([s[~bit], s[bit]])

    @staticmethod
    def _ones(words, before, i):
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[i >> 6] + np.bitwise_count(words[i >> 6] & low)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        base = np.zeros_like(i)
        for shift, words, before, zeros in self.levels:
            up = (symbol >> shift & 1).astype(bool)
            for_i, for_base = self._ones(words, before, i), self._ones(words, before, base)
            i = np.where(up, zeros + for_i, i - for_i)
            base = np.where(up, zeros + for_base, base - for_base)
        return i - base

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for shift, words, before, zeros in self.levels:
            up = (words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(words, before, i)
            out |= up.astype(np.int64) << shift
            i = np.where(up, zeros + ones, i - ones)
        return out


class FmIndex:
    """Counts and finds phrases in a sequence of symbols from 0 to ``symbols`` - 1.

    Texts end with a 0 each; ``starts`` are their first positions.  Phrases hold no 0.
    """

    def __init__(self, s: np.ndarray, starts: np.ndarray, symbols: int):
        bits = max(1, int(symbols - 1).bit_length())
        order = suffix_order(s, int(symbols).bit_length())
        self.size = len(s)
        self.first = np.r_[0, np.cumsum(np.bincount(s, minlength=symbols))].astype(np.int64)
        self.ranks = Ranks(s[order - 1], bits)
        sampled = order % SAMPLE_EVERY == 0
        begins = np.zeros(len(s), bool)
        begins[starts] = True
        self.sampled = sampled | begins[order]
        self.samples = order[self.sampled]
        self.sample_at = np.cumsum(self.sampled) - 1

    def search(self, phrases: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, position) of every occurrence: backward search, all phrases at once."""
        lengths = np.array([len(p) for p in phrases])
        table = np.zeros((len(phrases), max(lengths, default=0)), np.int64)
        for k, p in enumerate(phrases):
            table[k, : len(p)] = p[::-1]
        who = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        done = [np.empty((0, 3), np.int64)]
        for step in range(table.shape[1]):
            more = lengths[who] > step
            if not more.all():
                done.append(np.stack([who, low, high], 1)[~more])
                who, low, high = who[more], low[more], high[more]
            symbol = table[who, step]
            low = self.first[symbol] + self.ranks.rank(symbol, low)
            high = self.first[symbol] + self.ranks.rank(symbol, high)
            found = low < high
            who, low, high = who[found], low[found], high[found]
        who, low, high = np.concatenate([*done, np.stack([who, low, high], 1)]).T
        each = high - low
        rows = np.repeat(low - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
        return np.repeat(who, each), self._locate(rows)

    def _locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step to the symbol before until a sampled position."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while open_.size:
            known = self.sampled[rows]
            out[open_[known]] = self.samples[self.sample_at[rows[known]]] + steps[open_[known]]
            open_, rows = open_[~known], rows[~known]
            steps[open_] += 1
            symbol = self.ranks.symbol(rows)
            rows = self.first[symbol] + self.ranks.rank(symbol, rows)
        return out
