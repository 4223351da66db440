"""Query of the extraction; SQL has no tag stack, so tests hold it against written-out pages."""

from corpuscope.llm import html_extract


def op12_tag_path_text(spark, sf):
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


QUERIES = {"op12_tag_path_text": op12_tag_path_text}
ORACLES = {}
