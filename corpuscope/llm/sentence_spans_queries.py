"""Query of the removal of repeated passages; tests hold its sentence runs against brute force."""

from corpuscope.llm import sentence_spans


def op5_sentence_spans(spark, sf):
    """Every document without its repeated sentences and passages."""
    return sentence_spans.remove_passages(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op5_sentence_spans": op5_sentence_spans}
ORACLES = {}
