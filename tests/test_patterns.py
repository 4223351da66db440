"""Rendered patterns against CPython's re, which defines what they mean."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.corpus import TEMPLATES
from corpuscope import catalog
from corpuscope.functions.patterns import fold, found, java, needed_literal, occurrences, re2
from corpuscope.functions.text import folded, split_lines_count, squeeze_code, strip
from corpuscope.operators import language

EXTRA = [
    "", "\n", "body { a: b; }\n.x{y}", "a.b.c d.e'", "x" * 3000, "tsx", "a.css\n", "css\n", "json", "K: STRING\n\xa0x",
    "café: été\nnaïve: oui\n", "{ { : ; } }", "# {: ;}", "div div div { a : b ; c }", ".a-b-c {", 'x = "a"  :', "İ ı ſ K",
    "import a\nfrom b\nIMPORT {x} FROM 'y'", "a\x85b\u2028c\r\nd", "  ---  \n", "[core]\n", "a.b(c);", "aa.bb(1) x\n.cc(2);",
    "html" + "." * 50 + "{ }", "*{a}", "#{:;", "tab\there\x0b\x0cx",
]
INSENSITIVE = sorted({p for ps in catalog.LANGUAGE_PATTERNS.values() for p in ps} | set(
    catalog.CSS_SELECTORS + catalog.SCRIPT_HINTS + catalog.SCRIPT_EVIDENCE + catalog.CSS_PROPERTIES
    + [r"(?:\.|#|\*|body|html|div)[^{]*\{\s*[^}]*:[^}]*;[^}]*\}", r"(?:\.|#|\*|body|html|div)[^{]*\{\s*[^}]+\}"]))


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = EXTRA + [t[4].replace("@@", "some: words; and more") for t in TEMPLATES]
    rows += [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    rows += [r[0] for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").limit(10).collect()]
    return rows


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(8).cache()


def test_counts_and_presence_agree_with_cpython(frame, texts):
    low = F.col("low")
    for start in range(0, len(INSENSITIVE), 30):
        part = INSENSITIVE[start:start + 30]
        columns = [occurrences(low, fold(p)).alias(f"n{i}") for i, p in enumerate(part)]
        columns += [found(low, fold(p)).alias(f"f{i}") for i, p in enumerate(part)]
        for row in frame.withColumn("low", folded(F.col("t"))).select("id", *columns).collect():
            for i, p in enumerate(part):
                want = len(re.findall(p, texts[row.id], re.IGNORECASE))
                is_block = p.startswith(r"(?:\.|#|\*|body|html|div)[^{]*")  # used for presence only
                assert is_block or row[f"n{i}"] == want, (p, texts[row.id][:80])
                assert row[f"f{i}"] == bool(want), (p, texts[row.id][:80])


def test_first_groups_agree_with_cpython(frame, texts):
    cases = [language.FIRST_FILE, language.QUOTED_FILE, language.QUOTED_KNOWN_FILE]
    rows = frame.select("id", *[F.regexp_extract("t", java(p), 1).alias(f"g{i}") for i, p in enumerate(cases)]).collect()
    for row in rows:
        for i, p in enumerate(cases):
            hit = re.search(p, texts[row.id])
            assert row[f"g{i}"] == (hit.group(1) if hit else ""), (p, texts[row.id][:80])


def test_multiline_and_dialects_agree(frame, texts):
    cases = [r"^\s*[A-Z_]+=", r"^\s*\w+\s*:\s*\w+\s*$", r"\.css$", r"^\s*\[\w+\]", r"\.env$|requirements\.txt$"]
    rows = frame.select("id", *[F.regexp_count("t", F.lit(java(p, multiline=True))).alias(f"n{i}") for i, p in enumerate(cases)])
    con = duckdb.connect()
    for row in rows.collect():
        for i, p in enumerate(cases):
            want = len(re.findall(p, texts[row.id], re.MULTILINE))
            assert row[f"n{i}"] == want, (p, texts[row.id][:80])
            other = con.execute("SELECT len(regexp_extract_all(?, ?))", [texts[row.id], re2(p, multiline=True)]).fetchall()[0][0]
            assert other == want


def test_text_helpers_agree_with_cpython(frame, texts):
    rows = frame.select("id", squeeze_code(F.col("t")).alias("s"), strip(F.col("t")).alias("x"),
                        split_lines_count(F.col("t")).alias("n")).collect()
    for row in rows:
        text = texts[row.id]
        assert row.x == text.strip() and row.n == len(text.splitlines())
        want = re.sub(r"#.*$", "", text, flags=re.M)
        want = re.sub(r"/\*.*?\*/", "", re.sub(r"//.*$", "", want, flags=re.M), flags=re.S)
        assert row.s == re.sub(r"\s+", " ", want).strip()


def test_needed_literal():
    assert needed_literal(r"@import\s+url\(") == "@import"
    assert needed_literal(r"yml$|yaml$") is None
    assert needed_literal(r"border(?:-radius)?\s*:\s*") == "border"
    assert needed_literal(r"tsx?$") == "ts"


def test_long_texts_without_a_match_stay_cheap(spark):
    """Runs of words and of selector tokens, where the plain patterns would take minutes."""
    rows = spark.createDataFrame([("w" * 400_000,), ("." * 200_000 + "{",), ("." * 200_000 + "{ a } b",)], "content string")
    assert language.with_language(rows).count() == 3
