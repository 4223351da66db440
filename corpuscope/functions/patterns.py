"""One pattern text, two dialects.

Patterns are stated once in CPython ``re`` syntax, because that is the syntax whose
meaning has to be kept.  ``java`` renders a pattern for Spark and ``re2`` renders it
for engines built on RE2, which the SQL checks use.  The differences that matter:

* ``\\w``, ``\\s`` and ``\\d`` are Unicode classes in CPython and ASCII in both others;
* a bare ``{`` is a literal in CPython and an error in Java;
* ``$`` outside multi-line mode also matches before one final newline;
* ``.`` excludes only ``\\n`` in CPython, more than that in Java.

Case-insensitive patterns are matched by folding both sides (``fold`` here and
``text.folded`` for the column), which is cheaper than ``(?iu)`` and gives the same
answer for patterns whose letters are ASCII.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?:|\{\d+(?:,\d*)?\}|[*+?]|.", re.S
)
_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
_CLASSES = {r"\w": _WORD, r"\s": _SPACE, r"\d": r"\p{Nd}"}
# ECMAScript: ASCII words, no control separators, with the byte order mark
_ASCII_CLASSES = {r"\w": "A-Za-z0-9_", r"\s": r"\t\n\x0b\f\r\x{FEFF}\p{Z}", r"\d": "0-9"}

_TOKEN_NOT_BRACE = r"(?:\.|#|\*|body|html|div)"
_WORD_START = r"(?<![\p{L}\p{N}_])"
_WORDS = r"[\p{L}\p{N}_]++"

# Patterns whose plain form backtracks more than linearly in Java on long texts without
# a match.  Each value accepts exactly the texts (and finds exactly the groups) of its key.
_LINEAR_JAVA = {
    # only the last selector token before a brace has to be tried, and the block is
    # consumed once: first ':' in it, then first ';' after that, then its end
    r"(?:\.|#|\*|body|html|div)[^{]*\{\s*[^}]*:[^}]*;[^}]*\}": (
        rf"(?d){_TOKEN_NOT_BRACE}(?:(?!{_TOKEN_NOT_BRACE})[^{{])*+\{{[^}}:]*+:[^}};]*+;[^}}]*+\}}"
    ),
    r"(?:\.|#|\*|body|html|div)[^{]*\{\s*[^}]+\}": (
        rf"(?d){_TOKEN_NOT_BRACE}(?:(?!{_TOKEN_NOT_BRACE})[^{{])*+\{{[^}}]++\}}"
    ),
    # a run of word characters is entered at its start only
    r"(?:\/|\\)?(\w+\.\w+)(?:\'|\"|\s|$)": (
        rf"(?d){_WORD_START}({_WORDS}\.{_WORDS})(?:['\"]|[{_SPACE}]|\z)"
    ),
    r"\w+\.\w+\(.*\);": rf"(?d){_WORD_START}{_WORDS}\.{_WORDS}\(.*\);",
    # possessive repeat: no recursion on long hyphenated names
    r"\.\w+(-\w+)*\s*{": rf"(?d)\.{_WORDS}(?:-{_WORDS})*+[{_SPACE}]*+\{{",
    # leading optional blanks change neither presence nor count
    r'\s*"\w+"\s*:': rf'(?d)"{_WORDS}"[{_SPACE}]*+:',
}


def _render(pattern: str, java: bool, multiline: bool, ascii_words: bool) -> str:
    classes = _ASCII_CLASSES if ascii_words else _CLASSES
    out = []
    for token in _TOKEN.findall(pattern):
        if token in classes:
            out.append(f"[{classes[token]}]")
        elif len(token) > 1 and token[0] == "[":
            for name, body in classes.items():
                token = token.replace(name, body)
            out.append(token)
        elif token == "{":
            out.append(r"\{")
        elif token == "$":
            out.append("$" if multiline else (r"\z" if ascii_words else r"\n?\z"))
        elif token == r"\b" and java:
            out.append(f"(?![{classes[r'\w']}])")
        elif token in (r"\'", r"\"", r"\/"):
            out.append(token[1])
        else:
            out.append(token)
    return "".join(out)


def java(pattern: str, *, multiline=False, dotall=False, ignore_case=False, ascii_words=False) -> str:
    """Render for ``java.util.regex``."""
    if pattern in _LINEAR_JAVA and not (multiline or dotall or ascii_words):
        return _LINEAR_JAVA[pattern]
    flags = "d" + "m" * multiline + "s" * dotall + "i" * ignore_case
    return f"(?{flags})" + _render(pattern, True, multiline, ascii_words)


def re2(pattern: str, *, multiline=False, dotall=False, ignore_case=False, ascii_words=False) -> str:
    """Render for RE2."""
    flags = "m" * multiline + "s" * dotall + "i" * ignore_case
    return (f"(?{flags})" if flags else "") + _render(pattern, False, multiline, ascii_words)


def fold(pattern: str) -> str:
    """Lower-case the letters of a pattern, leaving its escapes alone."""
    return "".join(t if t[0] == "\\" else t.lower() for t in _TOKEN.findall(pattern))


def needed_literal(pattern: str) -> str | None:
    """The longest text every match must contain, or None when there is no such text."""
    best, run, depth = "", "", 0
    tokens = _TOKEN.findall(pattern) + [""]
    for token, after in zip(tokens, tokens[1:] + [""]):
        if token in ("(", "(?:"):
            depth += 1
        if depth == 0 and token == "|":
            return None
        plain = depth == 0 and (
            (len(token) == 1 and token not in "^$.*+?")
            or (len(token) == 2 and token[0] == "\\" and not token[1].isalnum())
        )
        if token == ")":
            depth -= 1
            plain = False
        optional = after in ("*", "?") or after.startswith("{0")
        if plain and not optional:
            run += token[-1]
        if not plain or optional or after in ("+",):
            best, run = max(best, run, key=len), ""
    return max(best, run, key=len) or None


def alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between the bars that stand outside of groups."""
    parts, depth = [""], 0
    for token in _TOKEN.findall(pattern):
        depth += (token in ("(", "(?:")) - (token == ")")
        if depth == 0 and token == "|":
            parts.append("")
        else:
            parts[-1] += token
    return parts


def found(text: Column, pattern: str, **flags) -> Column:
    """True where the pattern occurs in the text.

    The literal every match needs is looked for first: a substring search is far cheaper
    than a regular expression and settles most rows.  Alternatives that all have one are
    looked for one by one.
    """
    parts = alternatives(pattern)
    if len(parts) > 1 and not flags.get("ignore_case") and all(len(needed_literal(p) or "") > 1 for p in parts):
        return any_of([found(text, p, **flags) for p in parts])
    hit = F.rlike(text, F.lit(java(pattern, **flags)))
    literal = None if flags.get("ignore_case") else needed_literal(pattern)
    return F.contains(text, F.lit(literal)) & hit if literal else hit


def occurrences(text: Column, pattern: str, **flags) -> Column:
    """Number of non-overlapping matches."""
    n = F.regexp_count(text, F.lit(java(pattern, **flags)))
    literal = None if flags.get("ignore_case") else needed_literal(pattern)
    return F.when(F.contains(text, F.lit(literal)), n).otherwise(0) if literal else n


def first_group(text: Column, pattern: str, group: int = 1, **flags) -> Column:
    """A group of the first match, '' when there is none."""
    return F.regexp_extract(text, java(pattern, **flags), group)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def how_many(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.cast("int") for c in conditions])


def total(counts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, counts)
