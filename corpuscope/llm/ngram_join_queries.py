"""Query of the similarity join and its SQL."""

from __future__ import annotations

from corpuscope.llm import ngram_join


def op10_ngram_join(spark, sf):
    """Every document with the component of documents whose shingle sets are alike."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return ngram_join.component_ids(ngram_join.similar_groups(docs))


# equal sets share a component at once; other pairs meet on any shingle that few sets have or, for the rest, on size
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words),
nodes AS (SELECT s, len(s) AS n, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT node, n, unnest(s) AS g FROM nodes),
counted AS (
  SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
  FROM grams a JOIN grams b ON a.g = b.g AND a.node < b.node AND a.n * 80 <= b.n * 100 AND b.n * 80 <= a.n * 100
  GROUP BY ALL),
links AS (SELECT a, b FROM counted WHERE 100 * o >= 80 * (na + nb - o)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, root) AS (
  SELECT node, node FROM nodes
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(root, sets.doc_id) AS component_id
FROM sets LEFT JOIN nodes ON sets.s = nodes.s AND len(sets.s) > 0 LEFT JOIN roots USING (node)"""

QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLES = {"op10_ngram_join": SQL}
