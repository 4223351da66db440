"""Query of the resharding; SQL has no flow, so tests check sizes and moved bytes against brute force."""

from pyspark.sql import functions as F

from corpuscope.llm import reshard

SHARDS = 24


def op7_flow_reshard(spark, sf):
    """Documents that lie in 24 shards by source, one of them very large, in 24 shards of equal bytes."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(SHARDS))
    rows = reshard.Plan(docs, old, SHARDS).rewritten()
    return rows.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_flow_reshard": op7_flow_reshard}
ORACLES = {}
