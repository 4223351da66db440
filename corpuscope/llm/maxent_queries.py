"""Query of the language model; SQL cannot train it, so tests compare counts, base scores and held-out gain."""

from pyspark.sql import functions as F

from corpuscope.llm import maxent


def op2_hashed_maxent(spark, sf):
    """Every document, scored by a model of four fifths of them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    own = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return maxent.score(docs, own % 5 != 1)


QUERIES = {"op2_hashed_maxent": op2_hashed_maxent}
ORACLES = {}
