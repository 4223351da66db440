"""Query of the alignment; SQL has no tokenizers, so tests hold it against a plain count."""

from corpuscope.llm import token_links
from corpuscope.llm.token_units import Pair


def op13_token_links(spark, sf):
    """Every document's alignment and what the whole corpus says of its links."""
    return token_links.align(spark.read.parquet(f"{sf}/documents.parquet"), Pair.public())[0]


QUERIES = {"op13_token_links": op13_token_links}
ORACLES = {}
