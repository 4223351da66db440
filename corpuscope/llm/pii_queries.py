"""Query of the pseudonyms; SQL has no keyed permutation, so tests reverse it instead."""

from corpuscope.llm import pii

#: A key of the checks; a user passes a secret one.
KEY = b"corpuscope checks"


def op1_feistel_pseudonyms(spark, sf):
    """Every document with its personal data replaced."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return pii.pseudonymize(docs, KEY)


QUERIES = {"op1_feistel_pseudonyms": op1_feistel_pseudonyms}
ORACLES = {}
