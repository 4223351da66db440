"""Query of the exact search and its SQL."""

from pyspark.sql import functions as F

from corpuscope.llm import topk


def op8_nra_topk(spark, sf):
    """The 20 best of all vectors for every twentieth one."""
    vectors = topk.usable(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")


SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asks AS (SELECT vec_id, min(v) AS v FROM fine WHERE vec_id % 20 = 0 GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM asks q JOIN fine c ON q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20"""

QUERIES = {"op8_nra_topk": op8_nra_topk}
ORACLES = {"op8_nra_topk": SQL}
