"""Nearest reference example by cosine similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.steps import pinned
from corpuscope.functions.vectors import cosine, dot, norm

BLOCK_BYTES = 8 << 20


def nearest_reference(df: DataFrame, references: DataFrame, vector: str, name: str, order: str,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``best_match`` and ``similarity_score``; of equal scores the first reference wins.

    ``references`` has the columns ``name``, ``order`` and the vector.  They travel in blocks of
    about ``block_bytes`` each, one packed value a block, so every row is scored where it is: no
    join, no exchange of the corpus, and no limit on how many references there are.  A row keeps
    the best of all blocks.
    """
    size = references.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first()
    blocks = max(1, -(-size["n"] * (8 * (size["width"] or 0) + 64) // block_bytes))
    unit = F.transform(vector, lambda x: x.cast("double") / F.col("_norm"))
    units = pinned(references, {"_norm": norm(F.col(vector))}).where(F.col("_norm") > 0).select(
        F.struct(F.col(order).alias("ord"), F.col(name).alias("name"), unit.alias("unit")).alias("ref"),
        F.pmod(F.xxhash64(order), F.lit(blocks)).alias("block"))
    rows = pinned(df, {"_norm": norm(F.col(vector))})
    for k in range(blocks):
        packed = units.where(F.col("block") == k).agg(F.array_sort(F.collect_list("ref")).alias("refs"))
        scores = F.transform(
            f"_refs{k}",
            lambda r: F.struct(
                (dot(F.col(vector), r["unit"]) / F.nullif("_norm", F.lit(0.0))).alias("score"),
                (-r["ord"]).alias("first"), r["name"].alias("name")),
        )
        best = F.array_max(F.filter(scores, lambda s: s["score"] > -1))
        rows = pinned(rows.withColumn(f"_refs{k}", packed.scalar()), {f"_best{k}": best}).drop(f"_refs{k}")
    rows = pinned(rows, {"_best": F.array_max(F.array(*[f"_best{k}" for k in range(blocks)]))})
    return rows.select(
        *df.columns, F.col("_best.name").alias("best_match"), F.col("_best.score").alias("similarity_score"))


def pair_cosine(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.withColumn("cosine", cosine(F.col(left), F.col(right)))
