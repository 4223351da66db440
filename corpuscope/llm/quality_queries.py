"""Query of the quality classifier; a fitted model has no SQL, so tests use held-out labels."""

from pyspark.sql import functions as F

from corpuscope.llm import quality


def op3_bayes_quality(spark, sf):
    """Every document's evidence, site posteriors, posterior and decision; sites are source and language."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang")
    done = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.col("source"), F.col("lang"))
    return done.drop("text", "source", "lang")


QUERIES = {"op3_bayes_quality": op3_bayes_quality}
ORACLES = {}
