"""Splits, caps, folds, augmentation, stores and the stream."""

import math
import os

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import cleaning, evaluate, features, purpose, sampling
from corpuscope.plans.analyze import analyze
from corpuscope.sources import files, labelled, pages, store
from corpuscope.streaming import live


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows, a third of them with one label."""
    return spark.range(20_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("label")).cache()


def test_stratified_split_is_exact_and_whole(skewed):
    rows = sampling.stratified_split(skewed, "id", "label").groupBy("label", "split").count().collect()
    sizes = {r.label: r["count"] for r in skewed.groupBy("label").count().collect()}
    tests = {r.label: r["count"] for r in rows if r.split == "test"}
    assert sum(r["count"] for r in rows) == 20_000
    assert all(tests[k] == math.ceil(0.2 * n) for k, n in sizes.items())


def test_folds_are_balanced(skewed):
    rows = sampling.folds(skewed, "id", "label", 5).groupBy("label", "fold").count().collect()
    per = {}
    for r in rows:
        per.setdefault(r.label, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 and len(v) == 5 for v in per.values())


def test_rank_does_not_gather_a_label(skewed):
    plan = sampling.with_rank(skewed, ["label"], "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan.split("Window", 1)[1].split("\n", 1)[0]


def test_single_member_class_is_an_error(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, label string")
    with pytest.raises(Exception, match="single member"):
        sampling.stratified_split(rows, "id", "label", require_two=True).collect()


@pytest.mark.parametrize("keys", [[5], [1, 2, 3, 4], list(range(10)), [1, 10**12, 3, -7, 50, 51, 52, 53, 54, 10**15, 8]])
def test_tail_split_matches_slicing(spark, keys):
    rows = spark.createDataFrame([(k,) for k in keys], "id long")
    n = int(len(keys) * 0.2)
    want = sorted(keys)[-n:] if n else sorted(keys)
    assert sorted(r.id for r in sampling.tail_split(rows, "id").collect()) == want


def test_cap_limits_inside_tasks(skewed):
    capped = sampling.cap(skewed, ["label"], [F.desc("id")], 7)
    assert "WindowGroupLimit" in capped._jdf.queryExecution().executedPlan().toString()
    assert capped.groupBy("label").count().agg(F.max("count")).first()[0] == 7


def test_augment_bounds(spark):
    rows = spark.createDataFrame([(i, "x", "\n".join(map(str, range(n))), None) for i, n in enumerate((5, 19, 20, 29, 30, 31, 44, 200))],
                                 "sample_id long, language string, content string, source string")
    got = cleaning.augment(rows).collect()
    by = {(r.parent_id, r.variant): r.content.split("\n") for r in got}
    assert len(got) == 8 + 6 + 4 and len({r.sample_id for r in got}) == len(got)
    assert by[(2, "first_half")] == [str(i) for i in range(10)]
    for parent, n in ((4, 30), (5, 31), (6, 44), (7, 200)):
        part = [int(x) for x in by[(parent, "random_section")]]
        assert 15 <= len(part) <= 30 and part == list(range(part[0], part[0] + len(part))) and part[-1] < n
    assert {r.source for r in got} == {"unknown", "unknown:truncated:first_half", "unknown:truncated:random_section"}


def test_duplicates_keep_the_lowest_key(spark):
    rows = spark.createDataFrame([(3, "a  b"), (1, "a b"), (2, "a\nb"), (4, "c")], "doc_id long, content string")
    assert sorted(r.doc_id for r in cleaning.drop_duplicates(rows).collect()) == [1, 4]


def test_votes(spark):
    rows = spark.createDataFrame([("3",), (" 4\n",), ("2",), ("n/a",), ("-5",), (None,)], "v string")
    assert [r[0] for r in rows.select(cleaning.enough_votes(F.col("v"))).collect()] == [True, True, False, False, False, False]


def test_char_grams_by_brute_force(spark):
    text = "Ab  c😀é\n\nx"
    got = {r.gram: r.tf for r in features.term_counts(
        spark.createDataFrame([(1, text)], "k long, t string"), features.CharGrams("t", 1, 3), "k").collect()}
    squeezed, want = "ab c😀é x", {}
    for n in (1, 2, 3):
        for i in range(len(squeezed) - n + 1):
            want[squeezed[i:i + n]] = want.get(squeezed[i:i + n], 0) + 1
    assert got == want


def test_word_grams_by_brute_force(spark):
    got = {r.gram: r.tf for r in features.term_counts(
        spark.createDataFrame([(1, "The big, big a tree of été")], "k long, t string"),
        features.WordGrams("t", 1, 2, ("the", "of")), "k").collect()}
    assert got == {"big": 2, "tree": 1, "été": 1, "big big": 1, "big tree": 1, "tree été": 1}


def test_report_by_hand(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "d")], "t string, p string")
    got = {r.label: r for r in evaluate.classification_report(rows, "t", "p").collect()}
    assert (got["a"].precision, got["a"].recall, got["b"].precision, got["d"].support) == (1.0, 0.5, 0.5, 0)
    assert got["accuracy"].f1 == 0.5 and got["c"].f1 == 0.0
    cells = {(r.truth, r.predicted): r.n for r in evaluate.confusion_matrix(rows, "t", "p").collect()}
    assert len(cells) == 9 and cells[("a", "b")] == 1 and ("c", "d") not in cells


def test_missing_classes_only_when_needed(spark):
    one = spark.createDataFrame([("x", "API")], "content string, purpose string")
    two = spark.createDataFrame([("x", "API"), ("y", "Other")], "content string, purpose string")
    assert purpose.complete_classes(one).count() == 8 and purpose.complete_classes(two).count() == 2


def test_blocks_of_a_page(spark):
    html = "<pre class='x'>" + "a &lt; b &amp;&amp; <b>c</b> " * 6 + "</pre><pre>short</pre>"
    got = pages.extract_blocks(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), "pre").collect()
    assert len(got) == 1 and got[0].content.startswith("a < b && c ") and got[0].source == "page:u"


def test_code_in_pre_of_answers_with_votes(spark):
    long = "x = 1; " * 10
    html = f"<code>{long}outside</code><pre><code class='y'>{long}first</code> <b>no</b></pre><pre>{long}</pre><pre><code>{long}second</code></pre>"
    rows = spark.createDataFrame([(1, "u", html, " 3 "), (2, "u", html, "2"), (3, "u", html, "1k"), (4, "u", html, None)],
                                 "page_id long, url string, html string, votes string")
    got = pages.extract_blocks(rows, "pre code", origin="stackoverflow", votes="votes").orderBy("block_no").collect()
    assert [(r.page_id, r.content, r.source) for r in got] == [
        (1, long + "first", "stackoverflow:u"), (1, long + "second", "stackoverflow:u")]
    assert pages.extract_blocks(rows, "pre code").count() == 8


def test_store_reads_one_partition(spark, tmp_path):
    rows = spark.createDataFrame([(1, "C/C++", "x"), (2, "Go", "y")], "sample_id long, language string, content string")
    store.save_samples(rows, str(tmp_path / "s"))
    one = store.load_samples(spark, str(tmp_path / "s"), "C/C++")
    assert [r.sample_id for r in one.collect()] == [1]
    assert "PartitionFilters: [isnotnull(language_key" in one._jdf.queryExecution().executedPlan().toString()


def test_csv_keeps_blanks_quotes_and_line_breaks(spark, tmp_path):
    texts = ["  a\n\"b\",c  ", "x", "tail\\", "\t"]
    rows = spark.createDataFrame([(t, "L") for t in texts], "content string, language string")
    labelled.write_labelled_csv(rows, str(tmp_path / "c"))
    assert sorted(r.content for r in labelled.read_labelled_csv(spark, str(tmp_path / "c")).collect()) == sorted(texts)


def test_files_and_stream_equal_batch(spark, tmp_path):
    folder = tmp_path / "in" / "sub"
    os.makedirs(folder)
    (folder / "a.py").write_text("def f():\n    return 1\n")
    (folder / "b.css").write_text("body { margin: 0; }\n.a { top: 0; }\n")
    (folder / "bad.bin").write_bytes(b"abc \xff\xfe def g(x): pass")
    (folder / "empty.txt").write_text(" \n")
    batch = files.read_files(spark, str(tmp_path / "in"))
    assert "\ufffd" in batch.where("filename = 'bad.bin'").first().content
    query = live.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), once=True)
    query.awaitTermination()
    columns = ["doc_id", "filename", "language", "type", "confidence", "summary"]
    results = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.filename, r.error) for r in results.where("error IS NOT NULL").collect()] == [("empty.txt", "Empty file")]
    streamed = results.where("error IS NULL").select(columns)
    want = analyze(batch.where("filename <> 'empty.txt'")).select(columns)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, want.collect()))


def test_rule_path_plan(spark, sf):
    """One narrow stage without Python, and a filter on the result is not copied into the cascade."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = analyze(docs, "text").select("doc_id", "language", "confidence")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    filtered = analyze(docs.select("doc_id", "text"), "text").where("language = 'CSS' and doc_id < 9")
    text = filtered._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,9)]" in text and len(text) < 3 * len(plan)


def test_stream_keeps_rejected_files(spark, tmp_path):
    from corpuscope.streaming import live

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.py").write_text("def f(x):\n    return x\n")
    (folder / "b.txt").write_text(" \n")
    query = live.start(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "mark"), once=True)
    query.awaitTermination()
    rows = {r.filename: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows["a.py"].error is None and rows["a.py"].language == "Python"
    assert rows["b.txt"].error == "Empty file" and rows["b.txt"].language is None


def test_null_texts_are_no_copies(spark):
    from corpuscope.operators import cleaning

    rows = spark.createDataFrame([(1, None), (2, None), (3, "a b"), (4, "a  b"), (5, "c")], "doc_id long, content string")
    assert sorted(r.doc_id for r in cleaning.drop_duplicates(rows).collect()) == [1, 2, 3, 5]


def test_long_texts_are_not_cut(spark):
    from corpuscope.operators import cleaning

    rows = spark.createDataFrame([(1, "x" * 30_000, "Go", "s")], "sample_id long, content string, language string, source string")
    assert cleaning.large_enough(cleaning.preprocess(rows)).selectExpr("length(content)").first()[0] == 30_000
    assert cleaning.large_enough(cleaning.preprocess(rows, max_chars=5000), most=100).selectExpr("length(content)").first()[0] == 100


def test_splits_do_not_move_texts(spark, sf):
    import re

    from corpuscope.operators import models

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    for part in models.holdout(docs, "doc_id", "lang"):
        plan = part._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert moved and not any(re.search(r"\btext#", line) for line in moved)
        assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0]


def test_texts_as_files(spark, tmp_path):
    from corpuscope.sources.files import read_files, write_texts

    rows = [(1, "a\nb"), (2, None), (3, "é\U0001F600"), (3, ""), (-4, "/")]
    write_texts(spark.createDataFrame(rows, "doc_id long, content string").coalesce(1), f"file://{tmp_path}/a b")
    got = sorted(r.content for r in read_files(spark, f"{tmp_path}/a b").collect())
    assert got == sorted(["a\nb\0", "\0", "é\U0001F600\0\0", "/\0"])
    folders = {p.parent for p in tmp_path.rglob("*.txt")}
    assert len(folders) == 1  # a folder for each task, not for each text


def test_files_are_read_some_folders_at_a_time(spark, sf, tmp_path, monkeypatch):
    """No scan or stream lists more files than it is given, and all of them are read once."""
    from checks import io_checks
    from corpuscope.sources import files

    monkeypatch.setattr(files, "FILES_A_FOLDER", 7)
    files.write_texts(spark.range(100).selectExpr("id % 50 AS doc_id", "'x' AS content").coalesce(2), str(tmp_path / "in"))
    (tmp_path / "in" / "none").mkdir()
    parts = files.folders(spark, str(tmp_path / "in"), 20)
    sizes = [files.read_files(spark, p).count() for p in parts]
    assert sum(sizes) == files.read_files(spark, str(tmp_path / "in")).count() == 100 and max(sizes) <= 20 and len(sizes) > 4
    (tmp_path / "in" / "loose.txt").write_text("y")
    assert files.folders(spark, str(tmp_path / "in"), 20) == [str(tmp_path / "in")]

    of = lambda name: sorted(map(tuple, io_checks.QUERIES[name](spark, sf).collect()))
    whole = [of("file_scan"), of("stream_analyze")]
    listed, start = [], io_checks.live.start
    monkeypatch.setattr(files, "FILES_A_FOLDER", 50)
    monkeypatch.setattr(io_checks, "FILES_AT_ONCE", 100)
    monkeypatch.setattr(io_checks.live, "start", lambda spark, folder, *a, **b: listed.append(folder) or start(spark, folder, *a, **b))
    assert [of("file_scan"), of("stream_analyze")] == whole and len(listed) > 1


def test_gram_totals_by_brute_force(spark, monkeypatch):
    import pyarrow as pa

    from corpuscope.operators import grams

    monkeypatch.setattr(grams, "CHUNK", 40)
    texts = ["ab cé ab", None, "", "cé \U0001F600ab ab ab", "x\0y", "the the of", "ab " * 30]
    for kind, split, join in (("characters", list, "".join), ("words", str.split, " ".join)):
        for low, high in ((1, 1), (2, 4)):
            total, rows = {}, {}
            for t in texts:
                units = split(t or "")
                own = [join(units[i:i + n]) for n in range(low, high + 1) for i in range(len(units) - n + 1)]
                for g in own:
                    total[g] = total.get(g, 0) + 1
                for g in set(own):
                    rows[g] = rows.get(g, 0) + 1
            got = {}
            for b in grams.per_chunk(kind, low, high)([pa.record_batch([pa.array(texts, pa.string())], ["t"])]):
                for r in b.to_pylist():
                    t, d = got.get(r["gram"], (0, 0))
                    got[r["gram"]] = (t + r["total"], d + r["df"])
            assert got == {g: (total[g], rows[g]) for g in total}


def test_long_n_grams_are_pruned_without_loss(spark, monkeypatch):
    """The vocabulary is that of all n-grams, wherever its end lies, but few long ones are exchanged."""
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words[:rng.choice([3, 20, 60])]) for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["", None, "w1"]
    rows = spark.createDataFrame([(k // 2, t, str(k % 3)) for k, t in enumerate(texts)], "k long, t string, more string")
    for low, high, most, min_df in ((1, 4, 5, 1), (1, 4, 90, 2), (1, 3, 700, 2), (2, 4, 40, 1), (1, 4, 10**6, 2), (3, 4, 50, 1)):
        kind = features.WordGrams("t", low, high)
        for key in ("k", None):
            want = features.most_frequent(features.gram_totals(rows, kind, key), most, min_df).collect()
            texts_ = features._by_key(rows, kind, key, []) if key else rows.select(kind.prepared().alias("_texts"))
            for pairs in (200_000, 3):
                monkeypatch.setattr(features, "MOST_PAIRS", pairs)
                assert {tuple(r) for r in features._top(texts_, kind, most, min_df).collect()} == {tuple(r) for r in want}
    held, totals = [], features._totals
    monkeypatch.setattr(features, "MOST_PAIRS", 200_000)
    monkeypatch.setattr(features, "_totals", lambda *a: held.append(a[2:4] + (totals(*a).count(),)) or totals(*a))
    features.top_grams(rows, features.WordGrams("t", 1, 4), 60).collect()
    assert held[0][:2] == (1, 2) and held[1][:2] == (3, 4) and held[1][2] < totals(
        rows.select(features.WordGrams("t", 1, 4).prepared().alias("_texts")), "words", 3, 4).count() / 4
    # weights are made where the texts lie: nothing is exchanged behind the stored texts
    plan = features.tfidf(rows, features.WordGrams("t", 1, 3), "k", 50)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    keyed = {(r["k"], r["gram"]): (r["tf"], round(r["weight"], 9)) for r in features.tfidf(rows, features.WordGrams("t", 1, 3), "k", 50).collect()}
    length = {}
    for r in features.tfidf(rows, features.WordGrams("t", 1, 3), "k", 50, keep=["more"]).collect():
        length[r["k"]] = length.get(r["k"], 0) + r["weight"]**2
    assert all(abs(x - 1) < 1e-9 for x in length.values()) and {k for k, _ in keyed} == set(length)


def test_n_grams_of_repeated_keys_count_once(spark):
    rows = spark.createDataFrame([(1, "ab ab"), (1, "ab"), (None, "ab"), (2, None)], "k long, t string")
    got = {r.gram: (r.total, r.df) for r in features.gram_totals(rows, features.WordGrams("t", 1, 2), "k").collect()}
    assert got == {"ab": (4, 2), "ab ab": (1, 1)}
    plan = features.gram_totals(rows, features.WordGrams("t", 1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row for each n-gram of a text


def test_rare_classes_do_not_move_texts(spark):
    rows = spark.range(1_000_000).select(
        F.col("id").alias("sample_id"), F.when(F.col("id") < 5, "rare").when(F.col("id") > 9, "common").alias("language"),
        F.concat(F.lit("x" * 50), F.col("id").cast("string")).alias("content"), F.lit("s").alias("source"))
    done = cleaning.augment_rare(rows, 60)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert done.count() == 1_000_000
