"""Code blocks out of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.cleaning import enough_votes

# Entities resolved in block text; '&amp;' has to come last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def extract_blocks(pages: DataFrame, tag: str = "code", key: str = "page_id", html: str = "html",
                   link: str = "url", least: int = 50, origin: str = "page", votes: str | None = None) -> DataFrame:
    """(key, block_no, content, source): text of every ``tag`` element of at least ``least`` characters.

    ``pre code`` means code elements inside pre elements.  With ``votes``, a column of one answer's
    votes a row, only rows with enough of them count.
    Markup inside a block is dropped for ``code`` and ``pre``; script and style text is kept as it is.
    """
    *outer, tag = tag.split()
    names = [*outer, tag]
    elements = [
        lambda text, name=name: F.regexp_extract_all(text, F.lit(rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>"), F.lit(1)) for name in names]
    blocks = elements[0](F.col(html))
    for inside in elements[1:]:
        blocks = F.flatten(F.transform(blocks, lambda text: inside(text)))  # noqa: B023
    if votes is not None:
        pages = pages.where(enough_votes(F.col(votes).cast("string")))
    rows = pages.where(F.contains(F.col(html), F.lit(f"<{tag}"))).select(
        key, link, F.posexplode(blocks).alias("block_no", "content"))
    if tag in ("code", "pre"):
        rows = rows.withColumn("content", unescape(F.regexp_replace("content", "<[^>]*>", "")))
    rows = rows.where(F.length("content") >= least)
    return rows.select(key, "block_no", "content", F.concat(F.lit(f"{origin}:"), F.col(link)).alias("source"))
