"""Small helpers to write check SQL for DuckDB."""

from __future__ import annotations

from corpuscope.functions.patterns import fold, re2  # noqa: F401 (re2 is used by the checks)
from corpuscope.functions.text import FOLD_FROM, FOLD_TO, LINE_END, WHITESPACE


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def m(col: str, pattern: str, **flags) -> str:
    """Does the pattern occur?"""
    return f"regexp_matches({col}, {q(re2(pattern, **flags))})"


def n(col: str, pattern: str, **flags) -> str:
    """How often does it occur?"""
    return f"len(regexp_extract_all({col}, {q(re2(pattern, **flags))}))"


def mi(col: str, pattern: str) -> str:
    """Does it occur, case apart, in a folded column?"""
    return m(col, fold(pattern))


def ni(col: str, pattern: str) -> str:
    return n(col, fold(pattern))


def sub(col: str, pattern: str, by: str, **flags) -> str:
    return f"regexp_replace({col}, {q(re2(pattern, **flags))}, {q(by)}, 'g')"


def present(col: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"{mi(col, p)}::INT" for p in patterns) + ")"


def counted(col: str, patterns: list[str]) -> str:
    return "(" + " + ".join(ni(col, p) for p in patterns) + ")"


def strip(col: str) -> str:
    return f"trim({col}, {q(WHITESPACE)})"


def folded(col: str) -> str:
    return f"lower(translate({col}, {q(FOLD_FROM)}, {q(FOLD_TO)}))"


def md5_int(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def contains_any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def squeeze(col: str) -> str:
    text = sub(f"coalesce({col}, '')", r"#.*$", "", multiline=True)
    text = sub(text, r"//.*$", "", multiline=True)
    text = sub(text, r"/\*.*?\*/", "", dotall=True)
    return strip(sub(text, r"\s+", " "))


def cleaned(col: str, language: str, most: int | None = None) -> str:
    docs = sub(sub(col, r'"""[\s\S]*?"""', ""), r"'''[\s\S]*?'''", "")
    blocks = sub(col, r"/\*[\s\S]*?\*/", "")
    body = (f"CASE WHEN {language} = 'Python' THEN {docs} "
            f"WHEN {language} IN ('JavaScript','TypeScript','Java','C/C++','C#') THEN {blocks} ELSE {col} END")
    squeezed = sub(body, chr(92) + "n{3,}", chr(10) * 2)
    return f"substr({squeezed}, 1, {most})" if most else squeezed


def split_lines(col: str) -> str:
    return (f"(len(regexp_extract_all({col}, {q(LINE_END)})) + "
            f"({col} <> '' AND NOT regexp_matches({col}, {q('(?:' + LINE_END + ')' + chr(92) + 'z')}))::INT)")
