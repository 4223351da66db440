"""Bounded Arrow batches for columns of texts, and the other columns beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS = 1000
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``; from now on the session sends at most ROWS rows of them to Python at a time.

    Spark's default of 10,000 texts in a batch takes a worker hundreds of megabytes; a session that
    asks for less keeps its setting.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(SETTING)) <= ROWS:
        conf.set(SETTING, str(ROWS))
    return docs


def quoted(name: str) -> str:
    """A column's name as Spark reads it, blanks, dots and back-ticks included."""
    return "`" + name.replace("`", "``") + "`"


def in_row(docs: DataFrame, *left_out: str) -> Column:
    """The columns of ``docs`` as one struct with fields by position, whatever their names."""
    return F.struct(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in left_out], F.lit(0).alias("none")).alias("row")


def out_of_row(docs: DataFrame, *left_out: str, text: bool = True) -> list[Column]:
    """The columns of ``docs`` again, from the struct ``row``; with ``text`` the text is a column beside it."""
    return [F.col("text") if text and c == "text" else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns) if c not in left_out]


def row_schema(packed: DataFrame, others: str) -> StructType:
    """``row`` as ``packed`` has it, and other columns."""
    return StructType([packed.schema["row"], *StructType.fromDDL(others).fields])
