"""Sources, sinks, the stream and the trained models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.analysis_checks import ORACLES as ANALYSIS, analysis_sql, labelled_corpus
from checks.corpus import code_corpus, corpus_sql, read, scratch
from checks.data_checks import S, _augment_sql, _hash, _ranked, samples
from checks.sql import cleaned
from checks.text_checks import keyword_purpose_sql
from corpuscope.operators import cleaning, evaluate, models
from corpuscope.operators.language import extension_of
from corpuscope.plans import training
from corpuscope.plans.analyze import analyze, report, split_rejects
from corpuscope.sources import files, labelled, store
from corpuscope.sources.shared import stored
from corpuscope.streaming import live


def partitioned_store(spark, sf):
    folder = scratch(spark)
    store.save_samples(samples(spark, sf), folder)
    return store.load_samples(spark, folder).select("sample_id", "language", F.md5("content").alias("digest"))


def partitioned_store_one_language(spark, sf):
    folder = scratch(spark)
    store.save_samples(samples(spark, sf), folder)
    return store.load_samples(spark, folder, "C/C++").select("sample_id", "language", F.md5("content").alias("digest"))


def partitioned_store_rewrite(spark, sf):
    """One language is written anew, twice; the others stay."""
    folder = scratch(spark)
    rows = samples(spark, sf)
    store.save_samples(rows, folder)
    for tag in ("first ", "second "):
        new = rows.where("language = 'CSS'").withColumn("content", F.concat(F.lit(tag), "content"))
        store.save_samples(new, folder, only_theirs=True)
    return store.load_samples(spark, folder).select("sample_id", "language", F.md5("content").alias("digest"))


def labelled_csv(spark, sf):
    folder = scratch(spark)
    labelled.write_labelled_csv(samples(spark, sf).select("content", "language"), folder)
    return labelled.read_labelled_csv(spark, folder).groupBy("language", F.md5("content").alias("digest")).agg(F.count("*").alias("n"))


def stage_hand_over(spark, sf):
    folder = scratch(spark)
    processed = store.through_parquet(cleaning.preprocess(samples(spark, sf)), f"{folder}/processed")
    augmented = store.through_parquet(cleaning.augment(processed), f"{folder}/augmented")
    return augmented.groupBy("language", "variant").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def json_report(spark, sf):
    folder = scratch(spark)
    rows = report(labelled_corpus(spark, sf), model_purpose="keyword_purpose", model_confidence="model_confidence")
    files.write_report(rows, folder)
    return spark.read.schema(rows.schema).json(folder).select(
        "doc_id", "filename", "language", "error", F.col("analysis.language").alias("final_language"),
        F.col("analysis.type").alias("type"), F.col("analysis.confidence").alias("confidence"))


def file_scan(spark, sf):
    """The corpus written as one file per text, read back by the file scan, some folders at a time."""
    parts = [stored(files.read_files(spark, folder).where(F.col("filename") != "_SUCCESS").select(
        F.md5("content").alias("digest"), extension_of(F.col("filename")).alias("extension")
    ).groupBy("digest", "extension").agg(F.count("*").alias("n")), "scanned") for folder in _as_files(spark, sf)]
    return reduce(DataFrame.unionByName, parts).groupBy("digest", "extension").agg(F.sum("n").alias("n"))


FILES_AT_ONCE = 100_000


def _as_files(spark, sf) -> list[str]:
    """One text file per corpus row, in some folders that are read in turn."""
    folder = scratch(spark)
    files.write_texts(code_corpus(spark, sf), folder)
    return files.folders(spark, folder, FILES_AT_ONCE)


def stream_analyze(spark, sf):
    """Files arriving in folders, analysed by the streaming job of each, against the batch analysis of the same rows."""
    out, mark = scratch(spark), scratch(spark)
    for k, arriving in enumerate(_as_files(spark, sf)):
        query = live.start(spark, arriving, f"{out}/{k}", f"{mark}/{k}", once=True, files_per_batch=100_000)
        query.awaitTermination()
    found = reduce(DataFrame.unionByName, [spark.read.parquet(f"{out}/{i}") for i in range(k + 1)])
    return found.groupBy("language", "type", "confidence").agg(F.count("*").alias("n"))


# --- trained models: whole documents, no SQL counterpart ----------------------------------------

def _documents(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.col("text").alias("content"), F.col("lang").alias("language"))


GATE = 0.75  # the accuracy that trained models have to reach


def _scored(model, test, label):
    """Support of every held-out label, and whether the model reaches the gate on all of them."""
    pairs = stored(evaluate.pair_counts(models.predict(model, test), label, "predicted"), "pairs")
    share = pairs.agg(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).scalar()
    return pairs.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support")).withColumn("gate_met", share >= GATE)


def language_model_bayes(spark, sf):
    train, test = models.holdout(_documents(spark, sf), "doc_id", "language", stratified=False)
    return _scored(models.language_model_bayes(train), test, "language")


def language_model_forest(spark, sf):
    train, test = models.holdout(_documents(spark, sf), "doc_id", "language")
    return _scored(models.language_model_forest(train), test, "language")


def purpose_model_forest(spark, sf):
    rows = training.purpose_samples(samples(spark, sf)).where(F.col("sample_id").isNotNull())
    train, test = models.holdout(rows, "sample_id", "purpose", stratified=False)
    # at depth 10 it stays below the gate, so only what it scores is compared
    scored = models.predict(models.purpose_model_forest(train, max_depth=10), test)
    return scored.groupBy(F.col("purpose").alias("label")).agg(F.count("*").alias("support"), F.count("predicted").alias("scored"))


def purpose_model_boosted(spark, sf):
    # split, vocabulary, features and scores read the labelled rows, which cost more than the rest of a pass
    rows = stored(training.purpose_samples(samples(spark, sf)).where(F.col("sample_id").isNotNull()), "purposes")
    train, test = models.holdout(rows, "sample_id", "purpose")
    return _scored(models.purpose_model_boosted(train), test, "purpose")


def grid_search(spark, sf):
    """The reference's whole grid: n-gram range, vocabulary, trees and depth, three folds."""
    _, records = models.search_language(_documents(spark, sf), "doc_id", full=True)
    return spark.createDataFrame(
        [(f"{r['ngrams'][0]}-{r['ngrams'][1]}", r["vocabSize"], r["numTrees"], r["maxDepth"], round(float(r["accuracy"]), 6)) for r in records],
        "ngrams string, max_features int, trees int, max_depth int, accuracy double")


def analyze_with_models(spark, sf):
    """Analysis with trained models in place: the language of rows no rule settles, the purpose of all."""
    rows = samples(spark, sf)
    language_model = models.language_model_bayes(rows, max_features=2_000)
    purpose_model = models.purpose_model_forest(
        training.purpose_samples(rows).where(F.col("sample_id").isNotNull()), trees=20, max_depth=5, max_features=1_000)
    good, _ = split_rejects(rows)
    scored = models.predict(language_model, good, "model_language", "language_confidence", squeeze="content")
    scored = models.predict(purpose_model, scored, "model_purpose", "model_confidence", squeeze="content")
    done = analyze(scored.drop("language"), model_language="model_language", model_purpose="model_purpose",
                   model_confidence="model_confidence")
    return done.groupBy("language", "type").agg(F.count("*").alias("files"))


def train_pipeline(spark, sf):
    """Store, clean, augment, train both models, save, score."""
    rows = samples(spark, sf).select("sample_id", "language", "extension", "content", "source")
    *_, scores = training.train(
        spark, scratch(spark), rows, force=True,
        language_options={"trees": 20, "max_depth": 10},
        purpose_options={"iterations": 3, "max_depth": 3, "ngrams": (1, 1), "max_features": 1_000})
    return scores


QUERIES = {f.__name__: f for f in (
    partitioned_store, partitioned_store_one_language, partitioned_store_rewrite, labelled_csv, stage_hand_over, json_report, file_scan,
    stream_analyze, language_model_bayes, language_model_forest, purpose_model_forest, purpose_model_boosted,
    grid_search, analyze_with_models, train_pipeline)}

_HELD = "SELECT {label} AS label, count(*) AS support, true AS gate_met FROM ({rows}) WHERE {test} GROUP BY 1"
_PURPOSE = f"SELECT sample_id, {keyword_purpose_sql('content', 'language')} AS purpose FROM samples"
_P = (f"p AS (SELECT * FROM (SELECT sample_id, language, source, {cleaned('content', 'language')} AS content FROM samples "
      f"WHERE length(content) > 0) WHERE length(content) >= 50), {_augment_sql('p')}")
ORACLES = {
    "language_model_bayes": _HELD.format(label="lang", rows="SELECT * FROM documents", test=f"{_hash('doc_id')} % 100 < 20"),
    "language_model_forest": _HELD.format(label="lang", rows=_ranked("documents", "doc_id", "lang"), test="r <= ceil(n * 0.2::DOUBLE)"),
    "purpose_model_forest": f"{S} SELECT purpose AS label, count(*) AS support, count(*) AS scored FROM ({_PURPOSE}) "
                            f"WHERE {_hash('sample_id')} % 100 < 20 GROUP BY 1",
    "purpose_model_boosted": f"{S}, pur AS ({_PURPOSE}) " + _HELD.format(
        label="purpose", rows=_ranked("pur", "sample_id", "purpose"), test="r <= ceil(n * 0.2::DOUBLE)"),
    "partitioned_store": f"{S} SELECT sample_id, language, md5(content) AS digest FROM samples",
    "partitioned_store_one_language": f"{S} SELECT sample_id, language, md5(content) AS digest FROM samples WHERE language = 'C/C++'",
    "partitioned_store_rewrite": f"{S} SELECT sample_id, language, md5(CASE WHEN language = 'CSS' THEN 'second ' || content "
                                 "ELSE content END) AS digest FROM samples",
    "labelled_csv": f"{S} SELECT language, md5(content) AS digest, count(*) AS n FROM samples GROUP BY ALL",
    "stage_hand_over": f"{S}, {_P} SELECT language, variant, count(*) AS n, sum(length(content))::BIGINT AS chars FROM augmented GROUP BY ALL",
    "json_report": "SELECT doc_id, filename, language, error, final_language, type, confidence FROM (" + ANALYSIS["report"] + ")",
    "file_scan": f"WITH {corpus_sql()} SELECT md5(content || chr(0)) AS digest, 'txt' AS extension, count(*) AS n FROM corpus GROUP BY ALL",
    # the text writer ends every file with its separator
    "stream_analyze": f"WITH {corpus_sql()}, written AS (SELECT doc_id, content || chr(0) AS content FROM corpus), "
                      f"{analysis_sql('written', 'doc_id')} SELECT language, type, confidence, count(*) AS n FROM analysed GROUP BY ALL",
}
