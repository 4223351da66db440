import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscope.llm import decontaminate as d
from corpuscope.llm.fm_index import FmIndex, Ranks, suffix_order


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=12), min_size=1, max_size=6), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), max_size=6))
def test_index_finds_every_occurrence(texts, phrases):
    s = np.array([x for t in texts for x in [*t, 0]], np.int64)
    starts = np.r_[0, np.cumsum([len(t) + 1 for t in texts])[:-1]]
    order = suffix_order(s, 3)
    assert [tuple(s[i:]) for i in order] == sorted(tuple(s[i:]) for i in range(len(s)))
    who, where = FmIndex(s, starts, 5).search([np.array(p) for p in phrases])
    want = {(k, i) for k, p in enumerate(phrases) for i in range(len(s)) if tuple(s[i:i + len(p)]) == tuple(p)}
    assert sorted(zip(who.tolist(), where.tolist())) == sorted(want)


def test_ranks():
    s = np.random.default_rng(0).integers(0, 9, 300)
    ranks, at = Ranks(s, 4), np.arange(301)
    for c in range(9):
        assert (ranks.rank(np.full(301, c), at) == np.r_[0, np.cumsum(s == c)]).all()
    assert (ranks.symbol(np.arange(300)) == s).all()


def tables(spark):
    item = " ".join(f"word{i}" for i in range(14))
    docs = [(1, "Start. " + item.upper().replace(" ", ", ") + "! End."), (2, "word0 word1 word2"), (3, None), (4, ""), (5, "two words, here"), (5, "two words, here"),
            (6, " ".join(f"word{i}" for i in range(9)))]
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame([(7, item), (10, "Two words"), (11, None), (12, "..."), (None, "words here")], "item_id long, text string"))


def test_marks(spark):
    docs, items = tables(spark)
    rows = {r["doc_id"]: r for r in d.decontaminate(docs, items).collect()}
    assert [(s["low"], s["high"]) for s in rows[1]["spans"]] == [(1, 15)] and rows[1]["n_words"] == 16 and rows[1]["items"] == ["7"]
    assert rows[5]["items"] == ["", "10"] and [(s["low"], s["high"]) for s in rows[5]["spans"]] == [(0, 3)]
    assert all(not rows[k]["spans"] for k in (2, 3, 4, 6))


def test_removal_leaves_nothing_to_find(spark):
    docs, items = tables(spark)
    nested = spark.createDataFrame([(8, "left two two words words right two words")], "doc_id long, text string")
    cut = d.decontaminate(docs.union(nested), items, remove=True)
    rows = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert rows[1] == "Start. ! End." and rows[2] == "word0 word1 word2" and rows[8] == "left  right "
    assert d.decontaminate(cut, items).where("size(spans) > 0").count() == 0


def test_blocks_add_up(spark, monkeypatch):
    docs, items = tables(spark)
    key = lambda df: sorted((r["doc_id"] or 0, r["text"] or "", r["n_words"], str(r["spans"]), str(r["items"])) for r in df.collect())
    want = key(d.decontaminate(docs, items))
    monkeypatch.setattr(d, "MOST_BLOCK_BYTES", 10)
    assert len(d.blocks(items)) > 2 and key(d.decontaminate(docs, items)) == want


def test_odd_rows(odd_docs, no_docs, spark):
    _, items = tables(spark)
    for remove in (False, True):
        done = d.decontaminate(odd_docs, items, remove=remove)
        assert done.count() == odd_docs.count() and dict(done.dtypes)["items"] == "array<string>"
        assert d.decontaminate(no_docs, items, remove=remove).count() == 0
        assert d.decontaminate(odd_docs, items.limit(0), remove=remove).where("size(spans) > 0").count() == 0
