"""Cleaning, filtering, tokens, duplicates and augmentation of code samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import clean_code, md5_int, replace_all
from corpuscope.sources.shared import stored

TOKEN = r"[\p{L}_][\p{L}\p{N}_]*|\p{N}+|[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def large_enough(df: DataFrame, text: str = "content", least: int = 100, most: int | None = None) -> DataFrame:
    """Drop short contents; cut long ones only if ``most`` is given."""
    rows = df.where(F.length(text) >= least)
    return rows if most is None else rows.withColumn(text, F.substring(text, 1, most))


def has_content(df: DataFrame, text: str = "content") -> DataFrame:
    return df.where(F.length(F.coalesce(F.col(text), F.lit(""))) > 0)


def enough_votes(votes: Column, least: int = 3) -> Column:
    """Votes given as text; what is not a plain number counts as 0."""
    digits = F.btrim(votes, F.lit(" \t\n\r"))
    number = F.when(F.rlike(digits, F.lit(r"^\p{Nd}+$")), digits.try_cast("long"))
    return F.coalesce(number, F.lit(0)) >= least


def source_tag(origin: Column, *parts: Column) -> Column:
    """``origin:part/part``."""
    return F.concat(origin, F.lit(":"), F.concat_ws("/", *parts))


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def clean(df: DataFrame, text: str = "content", language: str = "language", max_chars: int | None = None) -> DataFrame:
    """Clean-only mode: no row is dropped, and none is cut unless ``max_chars`` is given."""
    return df.withColumn(text, clean_code(F.col(text), F.col(language), max_chars))


def preprocess(df: DataFrame, text: str = "content", language: str = "language", source: str = "source",
               least: int = 50, max_chars: int | None = None) -> DataFrame:
    """Non-empty rows, cleaned, long enough after cleaning, with a source."""
    rows = clean(has_content(df, text), text, language, max_chars).where(F.length(text) >= least)
    return with_defaults(rows, {source: "unknown"})


def tokens(df: DataFrame, text: str = "content") -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))


def token_table(df: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, position, token)"""
    return df.select(key, F.posexplode(tokens(df, text)).alias("position", "token"))


def fingerprint(text: Column) -> Column:
    return F.sha2(replace_all(text, r"\s+", " "), 256)


def drop_duplicates(df: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """Keep the lowest key of every group of texts equal up to white space.

    NULL texts are no copies of each other.  Only (fingerprint, key) is exchanged to find the keys
    of further copies; texts then meet that list of keys, which is short where copies are few.
    """
    prints = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), fingerprint(F.col(text)).alias("_print"))
    groups = prints.groupBy("_print").agg(F.min("_key").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    further = prints.join(groups, "_print").where("_key > _first").select(F.col("_key").alias(key))
    return df.join(further, key, "left_anti")


def augment(df: DataFrame, key: str = "sample_id", text: str = "content", source: str = "source") -> DataFrame:
    """Every sample, its first half from 20 lines on, and one 15 to 30 line section from 30 on.

    Start and length of the section come from the md5 of the key, so reruns and lost executors
    give the same rows.  One pass, no exchange.
    """
    key_text = F.col(key).cast("string")
    rows = df.withColumn("_lines", F.split(text, "\n"))
    n = F.size("_lines")
    start = F.when(n >= 30, md5_int(F.concat(key_text, F.lit(":start"))) % (n - 14)).cast("int")
    rows = rows.withColumns({"_n": n, "_from": start})
    room = F.least(F.col("_n") - F.col("_from"), F.lit(30))
    rows = rows.withColumn("_take", (15 + md5_int(F.concat(key_text, F.lit(":length"))) % (room - 14)).cast("int"))

    def variant(index, name, content, suffix):
        return F.struct(F.lit(index).alias("i"), F.lit(name).alias("variant"), content.alias("content"),
                        F.concat(F.coalesce(F.col(source), F.lit("unknown")), F.lit(suffix)).alias("source"))

    half = F.array_join(F.slice("_lines", F.lit(1), F.floor(F.col("_n") / 2).cast("int")), "\n")
    section = F.array_join(F.slice("_lines", F.col("_from") + 1, F.col("_take")), "\n")
    variants = F.array_compact(F.array(
        variant(0, "original", F.col(text), ""),
        F.when(F.col("_n") >= 20, variant(1, "first_half", half, ":truncated:first_half")),
        F.when(F.col("_n") >= 30, variant(2, "random_section", section, ":truncated:random_section")),
    ))
    others = [c for c in df.columns if c not in (key, text, source)]
    return rows.withColumn("_v", F.explode(variants)).select(
        (F.col(key) * 3 + F.col("_v.i")).alias(key),
        F.col(key).alias("parent_id"),
        F.col("_v.variant").alias("variant"),
        *others,
        F.col("_v.content").alias(text),
        F.col("_v.source").alias(source),
    )


def augment_rare(df: DataFrame, least: int, label: str = "language", key: str = "sample_id",
                 text: str = "content", source: str = "source") -> DataFrame:
    """Augment only the classes with fewer than ``least`` samples; other samples pass unchanged.

    The rare classes are one row per label and stored first: by their known size the join broadcasts
    them, and no text moves to the task of its label; too many of them are joined by exchange.
    """
    rare = stored(df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") < least).select(
        label, F.lit(True).alias("_rare")), "rare")
    marked = df.join(rare, label, "left")
    few = augment(marked.where(F.col("_rare")).drop("_rare"), key, text, source)
    many = marked.where(F.col("_rare").isNull()).drop("_rare").withColumns({
        "parent_id": F.col(key), "variant": F.lit("original"), key: F.col(key) * 3})
    return few.unionByName(many)


def union_sources(repositories: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of both origins; answers have no extension."""
    return repositories.unionByName(answers, allowMissingColumns=True)


def training_rows(collected: DataFrame | None, augmented: DataFrame | None, seeds: DataFrame,
                  always_add_seeds: bool) -> DataFrame:
    """Augmented and collected rows with the seeds.

    Language training always adds the seeds; purpose training uses them only when there is
    nothing else.
    """
    parts = [p for p in (augmented, collected) if p is not None]
    rows = None
    for part in parts:
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return seeds
    if always_add_seeds:
        return rows.unionByName(seeds)
    # decided inside the query: the seeds pass only where the count of other rows is 0
    count = rows.agg(F.count("*").alias("n")).scalar()
    return rows.unionByName(seeds.where(count == 0))
