"""Query of the packer: every piece of every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.llm import packing
from corpuscope.sources.shared import stored


def packed_digest(docs):
    """Where each piece lies, with a checksum of its ids instead of the ids."""
    pieces = stored(packing.cut(docs, packing.Vocabulary.public()), "pieces")
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(digest).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_pack(spark, sf):
    return packed_digest(spark.read.parquet(f"{sf}/documents.parquet"))


QUERIES = {"op6_pack": op6_pack}
ORACLES = {}
