from pyspark.sql import functions as F

from corpuscope.llm import quality


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels, F.col("source"), F.col("lang"), most=280).join(labels.withColumnRenamed("quality", "q"), "doc_id").collect()
    seen = {r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(280).collect()}
    held = [r for r in rows if r["doc_id"] not in seen]
    good = [r for r in held if r["q"] == 1 and r["toxic"] == 0]
    assert len(held) > 100
    assert sum(r["keep"] == (r["q"] == 1 and r["toxic"] == 0) for r in held) >= 0.9 * len(held)
    assert sum(r["keep"] for r in good) >= 0.97 * len(good)


def test_sparse_sites_shrink_to_the_prior(spark):
    # evidence is the same for every row of a site: one site good, one bad, one with a single bad row
    import numpy as np

    rows = [("good", "p", 3.0)] * 400 + [("bad", "p", -3.0)] * 400 + [("tiny", "p", -3.0)]
    scored = spark.createDataFrame([(h, p, e, e) for h, p, e in rows], "host string, path string, quality double, clean double")
    model = quality.Model(np.empty(0, np.uint64), np.zeros((2, 1)), np.zeros(2))
    share = {r["host"]: r["path_quality"] for r in quality.site_posteriors(scored, model).collect()}
    assert share["good"] > 0.9 and share["bad"] < 0.1 and 0.1 < share["tiny"] < 0.5


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 0), (None, 1, 1), (99, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    done = quality.classify(odd_docs, labels, F.col("source"), F.col("lang"))
    assert done.count() == odd_docs.count() and done.where("keep IS NULL").count() == 0 and "text" in done.columns
    assert quality.classify(no_docs, labels, F.col("source"), F.col("lang")).count() == 0
    none = quality.classify(odd_docs, labels.limit(0), F.col("source"), F.col("lang"))
    assert none.where("evidence_quality <> 0 OR evidence_clean <> 0").count() == 0
