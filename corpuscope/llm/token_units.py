"""Two tokenizers' tokens of the same bytes, aligned unit by unit.

Neither tokenizer has a token that goes on over a single space between two other characters, so a
text falls into units there and both end a token at each unit's end.  A unit's alignment is found
once and kept; at ``MOST_KEPT`` units the store starts anew.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

MOST_KEPT = 200_000
ODD_SPACE = re.compile(r"^\s|\s$|\s | \s")
UNIT_END = re.compile(r"(?<=\S) (?=\S)")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass(frozen=True)
class Pair:
    """Files of the two vocabularies, at the same place on every machine: byte-level BPE (its ranks too) and pieces."""
    a_file: str
    a_ranks: str
    a_pattern: str
    b_file: str

    @classmethod
    def public(cls) -> Pair:
        import public_tokenizers as p

        return cls(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN, p.path("piece_bpe_32k.model"))


def units_of(text: str) -> list[str]:
    """The units of space + text, each without the space before it."""
    if not ODD_SPACE.search(text):
        return text.split(" ")
    first, *rest = UNIT_END.split(" " + text)
    return [first[1:], *rest]


class Aligner(dict):
    """Number of each unit; its counts, its groups as text, and its links as keys b << 20 | a."""

    def __init__(self, pair: Pair):
        import sentencepiece
        import tiktoken

        super().__init__()
        with open(pair.a_ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding("ranks", pat_str=pair.a_pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_file = pair.a_file
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pair.b_file)
        self.a_bytes = {i: token for token, i in ranks.items()}
        self.b_bytes = []
        for i in range(self.pieces.vocab_size()):
            piece = self.pieces.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError("a piece goes on over a space")
            one = BYTE_PIECE.fullmatch(piece) if self.pieces.is_byte(i) else None
            self.b_bytes.append(bytes([int(one[1], 16)]) if one else piece.replace("▁", " ").encode())
        self.long_a = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.long_a[list(self.a_bytes)] = list(map(len, self.a_bytes.values()))
        self.long_b = np.array(list(map(len, self.b_bytes)), np.int64)
        self.restart()

    @cached_property
    def whole(self):
        """The tokenizer itself; its rank file gives the same ids of Latin text several times as fast."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.a_file)
        found.encode_special_tokens = True
        return found

    def restart(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.groups: list[str | None] = []  # None: not the bytes of the text
        self.counts = np.zeros((0, 3), np.int64)  # tokens of A, tokens of B, groups
        self.ends = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        return number

    def learn(self) -> None:
        """Align the units met since the last call: the plain ones all at once, the others one by one."""
        if not self.new:
            return
        plain = [k for k, unit in enumerate(self.new) if _latin(unit) and unit.strip() == unit != ""]
        done = self._all_at_once([self.new[k] for k in plain]) if plain else None
        if done is None:
            plain, done = [], ([], np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        shown, counts, sizes, links = done
        if len(plain) < len(self.new):
            others = sorted({*range(len(self.new))}.difference(plain))
            more = self._one_by_one([self.new[k] for k in others])
            order = np.argsort(np.r_[plain, others].astype(np.int64))
            shown = [*shown, *more[0]]
            shown = [shown[k] for k in order]
            counts, sizes, links = (np.concatenate(x) for x in zip((counts, sizes, links), more[1:], strict=True))
            begin = (np.cumsum(sizes) - sizes)[order]
            sizes = sizes[order]
            links = links[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(len(links))]
            counts = counts[order]
        at = len(self.groups)
        self.groups += shown
        last = int(self.ends[at])
        self.counts = _with(self.counts, at, counts)
        self.ends = _with(self.ends, at + 1, last + np.cumsum(sizes))
        self.links = _with(self.links, last, links)
        self.new = []

    def _all_at_once(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | None:
        """Groups, counts, numbers of links and links of units without white space at their ends.

        The units are tokenized as one text.  A link lies between two token ends that follow one
        another, whichever side they are of; a group between two ends of both sides.  None if the
        tokens are not the bytes of the text or go on over a unit's end.
        """
        text = " " + " ".join(units)
        data = text.encode()
        sizes = np.fromiter(map(len, units if len(data) == len(text) else map(str.encode, units)), np.int64, len(units)) + 1
        a, b = self.ranked.encode_ordinary(text), self.pieces.encode(text[1:], num_threads=1)
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b, ends_u = np.cumsum(self.long_a[a]), np.cumsum(self.long_b[b]), np.cumsum(sizes)
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        shared = ends[(ends_a[at_a] == ends) & (ends_b[at_b] == ends)]
        last = np.searchsorted(shared, ends_u)
        if (shared[last] != ends_u).any():
            return None
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        closes = np.ones(len(shared), np.int64)
        closes[last] = 2
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = self.shown_a[(shared[group_a] == ends_a).astype(np.int64), a]
        words[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = self.shown_b[
            np.where(shared[group_b] == ends_b, closes[group_b], 0), b]
        shown = "".join(words.tolist()).split("\n")[:-1]
        upto = np.column_stack([np.searchsorted(e, ends_u, "right") for e in (ends_a, ends_b, shared, ends)])
        counts = np.diff(upto, axis=0, prepend=0)
        return shown, counts[:, :3], counts[:, 3], b[at_b] << 20 | a[at_a]

    @cached_property
    def shown_a(self) -> np.ndarray:
        """Each id of A in front of a token of its side, and in front of the other side."""
        return np.array([[f"{i}{end}" for i in range(len(self.long_a))] for end in ",|"], object)

    @cached_property
    def shown_b(self) -> np.ndarray:
        """Each id of B in front of a token of its side, of a group, and of a unit."""
        return np.array([[f"{i}{end}" for i in range(len(self.long_b))] for end in ",;\n"], object)

    def _one_by_one(self, units: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
        """Groups, counts, numbers of links and links of any units; no group for one whose tokens are not its bytes."""
        groups, counts, sizes, links = [], [], [], []
        for unit, b in zip(units, self.pieces.encode(units, num_threads=1), strict=True):
            text = " " + unit
            a = self.ranked.encode_ordinary(text) if _latin(text) else self.whole.encode(text, add_special_tokens=False).ids
            parts_a, parts_b, data = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b], text.encode()
            if b"".join(parts_a) != data or b"".join(parts_b) != data:
                groups.append(None)
                counts.append((0, 0, 0))
                sizes.append(0)
                continue
            before = len(links)
            shown, n = _aligned(a, list(map(len, parts_a)), b, list(map(len, parts_b)), links)
            groups.append(shown)
            counts.append((len(a), len(b), n))
            sizes.append(len(links) - before)
        return groups, np.array(counts, np.int64).reshape(-1, 3), np.array(sizes, np.int64), np.array(links, np.int64)


def _latin(text: str) -> bool:
    return text.isascii() or max(text) < "ɐ"


def _with(held: np.ndarray, at: int, values) -> np.ndarray:
    """``held`` with values from ``at`` on; it doubles when it is full, so that learning does not copy it each time."""
    to = at + len(values)
    if to > len(held):
        held = np.concatenate([held, np.zeros((to + len(held), *held.shape[1:]), np.int64)])
    held[at:to] = values if len(values) else held[at:to]
    return held


def _aligned(a: list[int], long_a: list[int], b: list[int], long_b: list[int], links: list[int]) -> tuple[str, int]:
    """Groups as text and their number; a key of every overlap is added to ``links``."""
    groups, i, j, from_i, from_j = [], 0, 0, 0, 0
    end_a, end_b = long_a[0], long_b[0]
    while True:
        links.append(b[j] << 20 | a[i])
        step_a, step_b = end_a <= end_b, end_b <= end_a
        i, j = i + step_a, j + step_b
        if step_a and step_b:
            groups.append(f"{','.join(map(str, a[from_i:i]))}|{','.join(map(str, b[from_j:j]))}")
            if i == len(a):
                return ";".join(groups), len(groups)
            from_i, from_j = i, j
        if step_a:
            end_a += long_a[i]
        if step_b:
            end_b += long_b[j]


@lru_cache(maxsize=1)
def aligner(pair: Pair) -> Aligner:
    """One per worker process."""
    return Aligner(pair)
