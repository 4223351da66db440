"""The sample store: one partition per language, and Parquet hand-over between stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def language_key(language: Column) -> Column:
    return F.replace(F.lower(language), F.lit("/"), F.lit("_"))


def save_samples(samples: DataFrame, folder: str, language: str = "language", mode: str = "overwrite",
                 rows_per_file: int = 200_000, only_theirs: bool = False) -> None:
    """Write samples partitioned by language.

    ``mode`` overwrite replaces the whole store; with ``only_theirs`` it replaces the languages that
    ``samples`` has and leaves the others' files as they are.

    No exchange by language takes place, so a language with a third of all rows is written by as
    many tasks as read it.
    """
    (
        samples.withColumn("language_key", language_key(F.col(language)))
        .write.mode(mode).option("maxRecordsPerFile", rows_per_file)
        .option("partitionOverwriteMode", "dynamic" if only_theirs else "static")
        .partitionBy("language_key").parquet(folder)
    )


def load_samples(spark: SparkSession, folder: str, language: str | None = None) -> DataFrame:
    """All samples, or one language's: that reads its partition only."""
    rows = spark.read.parquet(folder)
    if language is not None:
        rows = rows.where(F.col("language_key") == language.lower().replace("/", "_"))
    return rows.drop("language_key")


def through_parquet(df: DataFrame, folder: str) -> DataFrame:
    """Write a stage and read it back: later stages start from files, not from the whole lineage."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
