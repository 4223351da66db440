import collections
import math
import zlib

from pyspark.sql import functions as F

from corpuscope.llm import maxent
from corpuscope.llm.maxent_queries import op2_hashed_maxent


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def check(rows, docs):
    counts = collections.Counter()
    for doc_id, text in docs:
        if zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 5 != 1:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for doc_id, text in docs:
        t = tokens(text)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        held = zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 5 == 1
        want[doc_id, held, len(t), sum(w in counts for w in t), n, round(base, 5)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want


def test_counts_base_scores_and_held_out_gain(spark, sf):
    rows = op2_hashed_maxent(spark, sf).collect()
    check(rows, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_add_up():
    import numpy as np

    rng = np.random.default_rng(1)
    weights = rng.normal(size=(maxent.KINDS, maxent.BUCKETS, maxent.CLASSES)).astype(np.float32)
    z = maxent.log_classes(weights, np.zeros(maxent.CLASSES, np.float32), [rng.integers(0, maxent.BUCKETS, 50) for _ in range(3)])
    assert np.allclose(np.exp(z).sum(1), 1, atol=1e-4)


def test_odd_rows(odd_docs, no_docs):
    own = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = maxent.score(odd_docs, own % 5 != 1).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert all(math.isfinite(r.score) for r in rows)
    assert maxent.score(no_docs, own % 5 != 1).count() == 0
    assert all(r.n_known == 0 for r in maxent.score(odd_docs, F.lit(False)).collect())


def test_words_in_a_class_follow_the_context_and_add_up(spark):
    import numpy as np

    # both words are of one form and have the same count; only the word before tells them apart
    fillers = [f"w{i}x" for i in range(200)]
    text = " ".join(f"{f} aa bbbb {f} cc dddd" for f in fillers * 2)
    docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string")
    study = docs.select("text")
    words = maxent.table_of(maxent.count_words(study))
    words.klass[:] = np.where(words.klass == 0, 0, 1 + maxent.OWN)  # as if no word were frequent enough to be a class
    words.total[:], words.distinct[:], words.mass[:] = 0, 0, 0
    words.group = maxent.hashed_group(words.head)
    np.add.at(words.total, words.klass, words.count)
    inside = words.klass > maxent.OWN
    words.mass[0, maxent.KNOWN:] = 0.5
    np.add.at(words.mass[0], words.group[inside], words.count[inside] + 0.5)
    weights = maxent.train(study, words)[1]
    bias = words.group_bias()
    rng = np.random.default_rng(2)
    for features in ([np.array([f]) for f in rng.integers(0, maxent.BUCKETS, 3)], [np.array([f[1]]) for f in maxent.buckets(
            words.head[:2], np.array([0, 2]))]):
        _, form, under = maxent.in_class(np.array([1 + maxent.OWN]), features)
        n = int(inside.sum())
        share = np.exp(maxent.log_words(weights, bias, np.repeat(form, n), [np.repeat(f, n) for f in under], words.group[inside]))
        groups = maxent.KNOWN + np.arange(maxent.SHARED)
        unseen = np.exp(maxent.log_words(weights, bias, np.repeat(form, maxent.SHARED), [np.repeat(f, maxent.SHARED) for f in under], groups))
        assert abs((share * (words.count[inside] + 0.5)).sum() + 0.5 * unseen.sum() - 1) < 1e-3
    assert np.abs(weights).max() > 0


def test_groups_hold_all_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    words = maxent.table_of(maxent.count_words(docs))
    for f in range(maxent.FORMS):
        k = 1 + maxent.OWN + f
        assert abs(words.mass[f].sum() - (words.total[k] + 0.5 * words.distinct[k] + 0.5 * maxent.SHARED)) < 1e-6
        here = words.group[words.klass == k]
        known = here[here < maxent.KNOWN]
        assert len(set(known)) == len(known) == min(len(here), maxent.KNOWN)
