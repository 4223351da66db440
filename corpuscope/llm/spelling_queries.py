"""Query of the spelling variants; DuckDB has no crc32, so a test holds it against brute force."""

from corpuscope.llm import spelling


def op11_pivotal_spelling(spark, sf):
    """Every frequent word of the corpus with its usual form."""
    return spelling.group(spark.read.parquet(f"{sf}/documents.parquet"))


QUERIES = {"op11_pivotal_spelling": op11_pivotal_spelling}
ORACLES = {}
