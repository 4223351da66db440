import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscope.llm import reshard
from corpuscope.llm.reshard_queries import SHARDS, op7_flow_reshard


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(1, 6))
def test_flow_moves_the_fewest_bytes(supply, shards):
    capacity = reshard.equal_capacities(sum(supply), shards)
    flow = reshard.cheapest_flow(supply, capacity, [[int(i != j) for j in range(shards)] for i in range(len(supply))])
    assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow)] == capacity
    stay = sum(min(s, c) for s, c in zip(supply, capacity))
    assert sum(n for i, r in enumerate(flow) for j, n in enumerate(r) if i != j) == sum(supply) - stay


def test_flow_takes_cheaper_ways():
    assert reshard.cheapest_flow([4, 0], [2, 2], [[1, 3], [0, 0]]) == [[2, 2], [0, 0]]
    assert reshard.cheapest_flow([2, 2], [3, 1], [[5, 1], [1, 9]]) == [[1, 1], [2, 0]]


def check(rows, docs, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(shards)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    key = lambda d, t: (d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8)
    assert sorted((key(*d) for d in docs), key=str) == sorted(((r["doc_id"], r["text_crc32"], r["size"]) for r in rows), key=str)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = op7_flow_reshard(spark, sf).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, docs, SHARDS)
    sizes = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(SHARDS)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def test_unaffected_shards_are_not_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 92) for i in range(400)], "doc_id long, text string")
    old = F.when(F.col("doc_id") < 100, 0).when(F.col("doc_id") < 300, 1).otherwise(2)
    plan = reshard.Plan(docs, old, 4)
    assert plan.moved == 10_000 and plan.affected == [1, 3]
    rows = plan.rewritten(str(tmp_path / "shards")).collect()
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == ["shard=1", "shard=3"]
    assert all(r["shard"] == (0 if r["doc_id"] < 100 else 2) for r in rows if r["doc_id"] < 100 or r["doc_id"] >= 300)
    assert len(rows) == 400


def test_odd_rows(odd_docs, no_docs):
    for docs, old in ((odd_docs, F.lit(None)), (odd_docs, F.col("doc_id") % 3), (no_docs, F.lit(0))):
        rows = reshard.Plan(docs, old, 3).rewritten().withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))).collect()
        check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 3)
