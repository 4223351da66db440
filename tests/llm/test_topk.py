import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscope.llm import topk


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(1, 6), st.integers(1, 5), st.sampled_from([1, 3, 30, 3000, 2**24]))
def test_lists_give_the_best(seed, n, m, k, span):
    rng = np.random.default_rng(seed)
    v, q = rng.integers(-span, span + 1, (n, m)), rng.integers(-span, span + 1, (4, m))
    ids = rng.permutation(n)
    own = np.array([ids[0], ids[-1], -1, -1])
    for j, found, scores in topk.SortedLists(ids, v).top(q, own, k):
        want = sorted((-int(s), int(i)) for s, i in zip(v @ q[j], ids) if i != own[j])[:k]
        assert [(-s, i) for s, i in zip(scores.tolist(), found.tolist())] == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (20, [0.1, -0.3]), (1, [0.2, 0.2]), (2, [0.2, 0.2]), (3, None), (40, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]),
            (7, [-0.01, 0.0]), (1, [0.2, 0.2]), (None, [1.0, 1.0]), (8, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("block", F.lit("x"))
    vectors = topk.usable(table, "vec_id", "embedding")
    found = topk.top_k(vectors, F.col("id") % 20 == 0, 3).orderBy("query_id", "rank").collect()
    held = [(0, [64, 32]), (20, [6, -20]), (1, [12, 12]), (2, [12, 12]), (7, [-1, 0]), (1, [12, 12]), (8, [0, 0])]
    want = []
    for q in (0, 20):
        best = sorted((-sum(a * b for a, b in zip(dict(held)[q], v)), i) for i, v in held if i != q)[:3]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert [tuple(r) for r in found] == want
    assert topk.top_k(vectors.limit(0), F.col("id") % 20 == 0).count() == 0


def test_every_row_of_an_id_is_a_candidate(spark):
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [5.0, 0.0]), (2, [2.0, 0.0]), (20, [3.0, 0.0])]
    vectors = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    found = topk.top_k(vectors, F.col("id") % 20 == 0, 2).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [(20, 1, 1, 64 * 320), (20, 2, 2, 64 * 128)]
    found = topk.top_k(vectors, F.col("id") % 20 == 0, 3).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in found] == [1, 2, 1]
