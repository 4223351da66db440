"""A corpus pipeline of the training-data operators: judge, deduplicate, decontaminate, pseudonymize, pack.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last
returns the packed pieces.  Between stages rows are written and read again, so each stage starts
from a table and a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import decontaminate, ngram_join, pii, quality
from corpuscope.llm.batches import quoted
from corpuscope.llm.packing_queries import packed_digest
from corpuscope.llm.pii_queries import KEY
from corpuscope.sources.shared import stored


def _with_texts_of(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; n_chars, where there is one, follows the new text."""
    return found.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(quoted(c)) for c, kind in docs.dtypes])


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are well written and not toxic; sites are source and language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, F.col("source"), F.col("lang")).where("keep").select(*map(quoted, docs.columns))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each_group(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_texts_of(decontaminate.decontaminate(docs, benchmark, remove=True), docs)


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return _with_texts_of(pii.pseudonymize(docs, KEY), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packed_digest(docs)


STAGES = [
    ("quality classifier", judge),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", remove_benchmark),
    ("PII", hide_persons),
    ("packing", pack),
]
#: Trained weights, suffix orders and keyed permutations have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
