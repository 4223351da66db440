"""Text building blocks as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.patterns import java

# The characters CPython's str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Letters that fold to an ASCII letter without being its plain lower case.
FOLD_FROM, FOLD_TO = "\u017f\u212a\u0130\u0131", "skii"
# Line ends recognised by str.splitlines().
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def folded(text: Column) -> Column:
    """Case-folded text of the same length, to be matched with folded patterns."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def replace_all(text: Column, pattern: str, by: str, **flags) -> Column:
    return F.regexp_replace(text, java(pattern, **flags), by)


def count_char(text: Column, char: str) -> Column:
    """Occurrences of one character, without a regular expression."""
    return F.length(text) - F.length(F.translate(text, char, ""))


def newline_lines(text: Column) -> Column:
    return count_char(text, "\n") + 1


def split_lines_count(text: Column) -> Column:
    """What ``len(text.splitlines())`` gives."""
    ends = F.regexp_count(text, F.lit(LINE_END))
    open_tail = (text != "") & ~F.rlike(text, F.lit(rf"(?:{LINE_END})\z"))
    return ends + open_tail.cast("int")


def squeeze_code(text: Column) -> Column:
    """Drop ``#`` / ``//`` / block comments, then collapse white space."""
    text = replace_all(F.coalesce(text, F.lit("")), r"#.*$", "", multiline=True)
    text = replace_all(text, r"//.*$", "", multiline=True)
    text = replace_all(text, r"/\*.*?\*/", "", dotall=True)
    return strip(replace_all(text, r"\s+", " "))


def clean_code(text: Column, language: Column, max_chars: int | None = None) -> Column:
    """Drop long comment blocks of the language, squeeze blank lines; cut to ``max_chars`` only if that is given."""
    docstrings = replace_all(replace_all(text, r'"""[\s\S]*?"""', ""), r"'''[\s\S]*?'''", "")
    blocks = replace_all(text, r"/\*[\s\S]*?\*/", "")
    body = (
        F.when(language == "Python", docstrings)
        .when(language.isin("JavaScript", "TypeScript", "Java", "C/C++", "C#"), blocks)
        .otherwise(text)
    )
    squeezed = replace_all(body, r"\n{3,}", "\n\n")
    return squeezed if max_chars is None else F.substring(squeezed, 1, max_chars)


def preview(text: Column, width: int = 50) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def round_half_even(value: Column, places: int = 2) -> Column:
    """Round as CPython's round(x * 10**n) / 10**n does."""
    scale = float(10**places)
    return F.rint(value * scale) / F.lit(scale)


def md5_int(text: Column) -> Column:
    """First 32 bits of the md5 as a non-negative long: a stable stand-in for randomness."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")

