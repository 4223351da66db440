"""Labelled CSV files and the built-in seed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscope import catalog


def read_labelled_csv(spark: SparkSession, path: str, label: str = "language") -> DataFrame:
    """(content, label) from a CSV with header; fields may hold line breaks and doubled quotes.

    The file schema is stated, so nothing is scanned to infer it.
    """
    return (
        spark.read.schema(f"content string, {label} string")
        .option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
        .option("lineSep", "\n")
        .csv(path)
    )


def write_labelled_csv(df: DataFrame, path: str, label: str = "language") -> None:
    """CSV with header; blanks around a field are part of it."""
    (
        df.select("content", label).write.mode("overwrite")
        .option("header", True).option("escape", '"').option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def _seeds(spark: SparkSession, table: dict[str, list[str]], label: str) -> DataFrame:
    rows = [(text, name) for name, texts in table.items() for text in texts]
    return spark.createDataFrame(rows, f"content string, {label} string")


def language_seeds(spark: SparkSession) -> DataFrame:
    return _seeds(spark, catalog.LANGUAGE_SEEDS, "language")


def purpose_seeds(spark: SparkSession) -> DataFrame:
    return _seeds(spark, catalog.PURPOSE_SEEDS, "purpose")
