"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from array import array
from functools import cached_property, lru_cache

MOST_CACHED = 250_000
SPECIAL = "<|endoftext|>"


class Encoder(dict):
    """Ids of a text as little-endian unsigned 32-bit bytes, put together from its space-free pieces.

    The vocabulary's pattern never matches across a single space between two other characters,
    except that the space opens what follows, so a text's ids are those of its pieces, each with
    its space in front.  Pieces are kept; at ``MOST_CACHED`` the store starts anew.
    The tokenizer itself is asked for pieces with letters beyond the Latin blocks and for special
    strings; its rank file, several times as fast and equal there, for all others.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import tiktoken

        super().__init__()
        self.tokenizer = tokenizer
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    @cached_property
    def whole(self):
        """Loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer)

    def ids(self, text: str) -> bytes:
        if text.isascii() and SPECIAL not in text or text and max(text) < "ɐ" and SPECIAL not in text:
            found = self.fast.encode_ordinary(text)
        else:
            found = self.whole.encode(text, add_special_tokens=False).ids
        return array("I", found).tobytes()

    def __missing__(self, piece: str) -> bytes | None:
        """None for a piece whose neighbouring spaces do not stand alone."""
        if len(self) >= MOST_CACHED:
            self.clear()
        alone = piece and not piece[0].isspace() and not piece[-1].isspace()
        self[piece] = found = self.ids(" " + piece) if alone else None
        return found

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self._irregular(text)
        try:
            return self.ids(first) + b"".join(map(self.__getitem__, rest))
        except TypeError:  # a None among them
            return self._irregular(text)

    def _irregular(self, text: str) -> bytes:
        """Pieces are joined again wherever a space has white space or nothing at its side."""
        out, held = [], None
        for piece in text.split(" "):
            if held is None:
                held, lead = piece, ""
            elif held and piece and not held[-1].isspace() and not piece[0].isspace():
                out.append(self.ids(lead + held) if not lead or held[0].isspace() else self._known(held))
                held, lead = piece, " "
            else:
                held += " " + piece
        out.append(self.ids(lead + held))
        return b"".join(out)

    def _known(self, piece: str) -> bytes:
        found = self[piece]
        return self.ids(" " + piece) if found is None else found


@lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str, pattern: str) -> Encoder:
    """One per worker process."""
    return Encoder(tokenizer, ranks, pattern)
