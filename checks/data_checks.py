"""Sampling, features, evaluation, similarity: queries and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.analysis_checks import labelled_corpus
from checks.corpus import code_corpus, corpus_sql, read, scratch
from checks.sql import cleaned, md5_int, q, sub
from checks.text_checks import _source_arms, detection_sql, keyword_purpose_sql
from corpuscope import catalog
from corpuscope.operators import cleaning, evaluate, features, language as lang, sampling, similarity
from corpuscope.operators.purpose import source_purpose
from corpuscope.plans.training import collect, purpose_samples
from corpuscope.sources.store import through_parquet
from corpuscope.sources.labelled import language_seeds, purpose_seeds


def samples(spark, sf):
    return code_corpus(spark, sf).withColumnRenamed("doc_id", "sample_id").withColumn(
        "extension", lang.extension_of(F.col("filename")))


# --- sampling ------------------------------------------------------------------------------------

def cap_per_language(spark, sf):
    rows = sampling.cap(samples(spark, sf), ["language", "origin"], [F.desc("stars"), F.asc("sample_id")], 10)
    return rows.select("sample_id", "language", "origin", "stars")


def collect_samples(spark, sf):
    rows = samples(spark, sf)
    columns = ["sample_id", "language", "extension", "content", "source"]
    files = rows.where(F.col("origin") != "stackoverflow").select(*columns, "stars")
    answers = rows.where(F.col("origin") == "stackoverflow").select("sample_id", "language", "content", "source", "votes")
    return collect(files, answers, 30).select(
        "sample_id", "language", "extension", F.md5("content").alias("digest"), "source")


def tail_split(spark, sf):
    return sampling.tail_split(samples(spark, sf), "sample_id").select("sample_id", "language")


def hash_split(spark, sf):
    return sampling.hash_split(samples(spark, sf), "sample_id").select("sample_id", "split")


def stratified_split(spark, sf):
    return sampling.stratified_split(samples(spark, sf), "sample_id", "language").select("sample_id", "language", "split")


def label_stratified_split(spark, sf):
    return sampling.stratified_split(read(spark, sf, "labels"), "doc_id", "quality").select("doc_id", "quality", "split")


def three_way_split(spark, sf):
    return sampling.three_way_split(samples(spark, sf), "sample_id", "language").select("sample_id", "split")


def kfold(spark, sf):
    return sampling.folds(samples(spark, sf), "sample_id", "language", 5).select("sample_id", "fold")


def repeated_kfold(spark, sf):
    return sampling.folds(samples(spark, sf), "sample_id", "language", 3, iterations=2).select("sample_id", "fold_1", "fold_2")


def budget_per_source(spark, sf):
    rows = sampling.budget_per_source(read(spark, sf, "documents"), "doc_id", "source", 300)
    return rows.select("doc_id", "source")


def augment(spark, sf):
    rows = cleaning.augment(cleaning.preprocess(samples(spark, sf)))
    return rows.select("sample_id", "parent_id", "variant", "language", F.md5("content").alias("digest"), "source")


def rare_class_augment(spark, sf):
    rows = cleaning.augment_rare(samples(spark, sf), 60)
    return rows.select("sample_id", "parent_id", "variant", "language", F.md5("content").alias("digest"))


def language_training_rows(spark, sf):
    rows = samples(spark, sf).select("content", "language")
    return cleaning.training_rows(rows, rows, language_seeds(spark), True).groupBy("language").agg(F.count("*").alias("n"))


def purpose_training_rows(spark, sf):
    rows = code_corpus(spark, sf).select("content", source_purpose(F.col("source")).alias("purpose"))
    return cleaning.training_rows(rows, None, purpose_seeds(spark), False).groupBy("purpose").agg(F.count("*").alias("n"))


def purpose_training_seeds(spark, sf):
    """The same rule where no row was collected: the seeds stand in."""
    rows = code_corpus(spark, sf).where(F.col("content").isNull()).select("content", source_purpose(F.col("source")).alias("purpose"))
    return cleaning.training_rows(rows, None, purpose_seeds(spark), False).groupBy("purpose").agg(F.count("*").alias("n"))


def purpose_training_set(spark, sf):
    return purpose_samples(samples(spark, sf)).groupBy("purpose", "language").agg(F.count("*").alias("n"))


def stage_totals(spark, sf):
    return evaluate.totals(code_corpus(spark, sf), "language")


# --- features ------------------------------------------------------------------------------------

def char_vocabulary(spark, sf):
    return features.most_frequent(char_document_frequency(spark, sf), 10_000)


def char_document_frequency(spark, sf):
    return features.gram_totals(read(spark, sf, "documents"), features.CharGrams("text", 2, 4), "doc_id")


def char_tfidf(spark, sf):
    rows = features.tfidf(read(spark, sf, "documents"), features.CharGrams("text", 1, 2), "doc_id", 10_000, 3)
    return rows.select("doc_id", "gram", "tf", F.round("weight", 6).alias("weight"))


def word_tfidf(spark, sf):
    rows = features.tfidf(read(spark, sf, "documents"), features.WordGrams("text", 1, 2), "doc_id", 5_000)
    return rows.select("doc_id", "gram", "tf", F.round("weight", 6).alias("weight"))


STOP = ["the", "and", "of", "to", "in", "que", "le", "de", "und", "der"]


def word_tfidf_stopped(spark, sf):
    grams = features.WordGrams("text", 1, 4, tuple(STOP))
    rows = features.tfidf(read(spark, sf, "documents"), grams, "doc_id", 20_000, 2)
    return rows.select("doc_id", "gram", "tf", F.round("weight", 6).alias("weight"))


def _weighted_documents(spark, sf):
    """Weights of the documents with their split, written once: scores read them several times."""
    docs = sampling.hash_split(read(spark, sf, "documents"), "doc_id")
    weights = features.tfidf(docs, features.CharGrams("text", 1, 2), "doc_id", 2_000, 3, keep=["lang", "split"])
    return through_parquet(weights, scratch(spark))


def _document_scores(spark, sf):
    weights = _weighted_documents(spark, sf)
    return features.naive_bayes_scores(
        weights.where(F.col("split") == "train"), weights.where(F.col("split") == "test"), "doc_id", "lang")


def nb_scores(spark, sf):
    """Language of the documents by naive Bayes over character 1-2-grams, trained on the hash-split rest."""
    return _document_scores(spark, sf).select("doc_id", "lang", F.round("score", 4).alias("score"))


def nb_predictions(spark, sf):
    return features.best_label(_document_scores(spark, sf), "doc_id", "lang")


# --- evaluation ----------------------------------------------------------------------------------

def predictions(spark, sf):
    """Declared language against detected language, expected purpose against keyword purpose."""
    rows = lang.with_language(code_corpus(spark, sf).withColumnRenamed("language", "declared"))
    rows = rows.withColumn("expected_purpose", source_purpose(F.col("source")))
    from corpuscope.operators.purpose import with_keyword_purpose

    return with_keyword_purpose(rows).withColumnRenamed("language", "predicted")


def accuracy(spark, sf):
    return evaluate.accuracy(predictions(spark, sf), "declared", "predicted")


def classification_report(spark, sf):
    return evaluate.classification_report(predictions(spark, sf), "declared", "predicted")


def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(predictions(spark, sf), "declared", "predicted")


def label_report(spark, sf):
    return evaluate.classification_report(read(spark, sf, "labels"), "quality", "toxic")


def label_confusion(spark, sf):
    return evaluate.confusion_matrix(read(spark, sf, "labels"), "quality", "toxic")


def accepted_alternatives(spark, sf):
    """Right or accepted purposes.  The styles are called what the check's table accepts."""
    rows = labelled_corpus(spark, sf).select(
        "doc_id", F.when(F.col("language") == "CSS", "Styling").otherwise(F.col("keyword_purpose")).alias("expected"),
        F.when(F.col("keyword_purpose") == "Styling", "UI Styling").otherwise(F.col("keyword_purpose")).alias("predicted"))
    return evaluate.with_accepted(rows, "expected", "predicted")


def pass_rate(spark, sf):
    rows = evaluate.with_accepted(predictions(spark, sf), "expected_purpose", "keyword_purpose")
    return evaluate.pass_rate(rows, F.col("declared") == F.col("predicted"), F.col("accepted"))


def example_evaluation(spark, sf):
    from corpuscope.functions.text import preview

    rows = predictions(spark, sf)
    return rows.select("doc_id", F.col("declared").alias("true_language"), "predicted",
                       (F.col("declared") == F.col("predicted")).alias("correct"), preview(F.col("content")).alias("sample"))


def distinct_labels(spark, sf):
    return code_corpus(spark, sf).select("language").distinct()


# --- similarity ----------------------------------------------------------------------------------

def _references(spark, sf):
    """One reference per label: the vector with the lowest id."""
    vectors = read(spark, sf, "embeddings")
    return vectors.groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("ord"),
    ).withColumn("name", F.concat(F.lit("label "), F.col("label").cast("string")))


def nearest_reference(spark, sf):
    done = similarity.nearest_reference(
        read(spark, sf, "embeddings"), _references(spark, sf), "embedding", "name", "ord")
    return done.select("vec_id", "best_match", F.round("similarity_score", 6).alias("score"))


def label_cosine(spark, sf):
    """Every vector against the reference of its own label."""
    refs = _references(spark, sf).select("label", F.col("embedding").alias("reference"))
    pairs = read(spark, sf, "embeddings").join(refs, "label")
    return similarity.pair_cosine(pairs, "embedding", "reference").select("vec_id", F.round("cosine", 6).alias("cosine"))


QUERIES = {f.__name__: f for f in (
    cap_per_language, collect_samples, tail_split, hash_split, stratified_split, label_stratified_split, three_way_split,
    kfold, repeated_kfold, budget_per_source, augment, rare_class_augment, language_training_rows, purpose_training_rows,
    purpose_training_seeds,
    purpose_training_set, stage_totals, char_vocabulary, char_document_frequency, char_tfidf, word_tfidf,
    word_tfidf_stopped, nb_scores, nb_predictions, accuracy, classification_report, confusion_matrix, label_report,
    label_confusion, accepted_alternatives, pass_rate, example_evaluation, distinct_labels, nearest_reference, label_cosine)}


# --- SQL -----------------------------------------------------------------------------------------

C = corpus_sql()


def _hash(key, salt="42:"):
    return md5_int(f"{q(salt)} || {key}::VARCHAR")


def _ranked(source, key, label, salt="42:"):
    h = _hash(key, salt)
    return (f"SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {h}, {key}) AS r, "
            f"count(*) OVER (PARTITION BY {label}) AS n FROM {source}")


def _augment_sql(source, key="sample_id"):
    """CTEs ending in augmented."""
    k = f"{key}::VARCHAR"
    return f"""
s1 AS MATERIALIZED (SELECT *, string_split(content, chr(10)) AS l, {md5_int(k + " || ':start'")} AS h1, {md5_int(k + " || ':length'")} AS h2 FROM {source}),
s2 AS MATERIALIZED (SELECT *, len(l) AS n, h1 % greatest(len(l) - 14, 1) AS f FROM s1),
s3 AS MATERIALIZED (SELECT *, 15 + h2 % greatest(least(n - f, 30) - 14, 1) AS t FROM s2),
augmented AS MATERIALIZED (SELECT {key} * 3 AS sample_id, {key} AS parent_id, 'original' AS variant, language, content, source FROM s3
 UNION ALL SELECT {key} * 3 + 1, {key}, 'first_half', language, array_to_string(l[1:n // 2], chr(10)), source || ':truncated:first_half' FROM s3 WHERE n >= 20
 UNION ALL SELECT {key} * 3 + 2, {key}, 'random_section', language, array_to_string(l[f + 1:f + t], chr(10)), source || ':truncated:random_section' FROM s3 WHERE n >= 30)"""


def _squeezed(col):
    return sub(f"lower({col})", r"\s\s+", " ")


def _char_grams_sql(source, low, high, key="doc_id", text="text"):
    parts = " UNION ALL ".join(
        f"SELECT {key}, unnest(list_transform(range(1, length(t) - {n} + 2), lambda i: substr(t, i, {n}))) AS gram FROM sq"
        for n in range(low, high + 1))
    return f"sq AS MATERIALIZED (SELECT {key}, {_squeezed(text)} AS t FROM {source}), grams AS ({parts})"


def _word_grams_sql(source, low, high, stop=()):
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
    if stop:
        words = f"list_filter({words}, lambda w: w NOT IN ({', '.join(q(x) for x in stop)}))"
    parts = " UNION ALL ".join(
        f"SELECT doc_id, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS gram FROM sq"
        for n in range(low, high + 1))
    return f"sq AS MATERIALIZED (SELECT doc_id, {words} AS w FROM {source}), grams AS ({parts})"


def _tfidf_sql(grams, source, k, min_df=1):
    return f"""{grams},
terms AS MATERIALIZED (SELECT doc_id, gram, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS MATERIALIZED (SELECT gram, sum(tf) AS total, count(*) AS df FROM terms GROUP BY gram HAVING count(*) >= {min_df} ORDER BY total DESC, gram LIMIT {k}),
w0 AS MATERIALIZED (SELECT doc_id, gram, tf, tf * (ln((1 + (SELECT count(*) FROM {source}))::DOUBLE / (1 + df)) + 1) AS w FROM terms JOIN vocab USING (gram)),
weights AS MATERIALIZED (SELECT doc_id, gram, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w0)"""


_nb = f"""WITH docs AS (SELECT *, CASE WHEN {_hash('doc_id')} % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM documents),
{_tfidf_sql(_char_grams_sql('documents', 1, 2), 'documents', 2000, 3)},
lw AS MATERIALIZED (SELECT w.*, lang, split FROM weights w JOIN docs USING (doc_id)),
tr AS (SELECT * FROM lw WHERE split = 'train'), te AS MATERIALIZED (SELECT * FROM lw WHERE split = 'test'),
v AS (SELECT count(DISTINCT gram) AS v FROM tr),
pri AS (SELECT lang, ln(count(DISTINCT doc_id)::DOUBLE / (SELECT count(DISTINCT doc_id) FROM tr)) AS p FROM tr GROUP BY lang),
grid AS (SELECT lang, gram FROM pri, (SELECT DISTINCT gram FROM lw)),
cg AS (SELECT lang, gram, sum(weight) AS s FROM tr GROUP BY ALL), ct AS (SELECT lang, sum(s) AS tot FROM cg GROUP BY lang),
lp AS MATERIALIZED (SELECT g.lang, g.gram, ln((coalesce(s, 0) + 1) / (tot + v)) AS lp FROM grid g LEFT JOIN cg USING (lang, gram) JOIN ct USING (lang), v),
scores AS MATERIALIZED (SELECT doc_id, lp.lang, any_value(p) + sum(weight * lp) AS score FROM te JOIN lp USING (gram) JOIN pri ON pri.lang = lp.lang GROUP BY doc_id, lp.lang)"""

_PRED = (f"WITH {C}, renamed AS (SELECT doc_id, content, source, language AS declared FROM corpus), "
         f"{detection_sql('renamed', 'doc_id', keep=', declared, source')}, "
         f"pred AS MATERIALIZED (SELECT doc_id, declared, language AS predicted, code AS content, CASE {_source_arms} ELSE 'Other' END AS expected_purpose, "
         f"{keyword_purpose_sql('code', 'language')} AS keyword_purpose FROM detected)")


def _report_sql(head, t, p, source):
    return f"""{head} per AS MATERIALIZED (SELECT label, coalesce(tp / nullif(g, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, tp, support FROM (
  SELECT label, (SELECT count(*) FROM {source} WHERE {t} = label AND {p} = label)::DOUBLE AS tp, (SELECT count(*) FROM {source} WHERE {t} = label) AS support,
         (SELECT count(*) FROM {source} WHERE {p} = label) AS g FROM (SELECT {t} AS label FROM {source} UNION SELECT {p} FROM {source}))),
f AS MATERIALIZED (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM per)
SELECT label::VARCHAR AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f"""


def _confusion_sql(head, t, p, source):
    return (f"{head} l AS (SELECT DISTINCT {t} AS x FROM {source}) SELECT a.x AS truth, b.x AS predicted, "
            f"(SELECT count(*) FROM {source} WHERE {t} = a.x AND {p} = b.x) AS n FROM l a, l b")


_refs = "refs AS (SELECT label, min(vec_id) AS ord, arg_min(embedding, vec_id)::DOUBLE[] AS ref FROM embeddings GROUP BY label)"
_accepted = " OR ".join(f"(expected = {q(k)} AND predicted IN ({', '.join(q(x) for x in v)}))" for k, v in catalog.ACCEPTED_PURPOSES.items())
_lang_seeds = ", ".join(f"({q(k)}, {len(v)})" for k, v in catalog.LANGUAGE_SEEDS.items())
S = f"WITH {C}, samples AS (SELECT doc_id AS sample_id, * EXCLUDE (doc_id) FROM corpus)"

ORACLES = {
    "cap_per_language": f"{S} SELECT sample_id, language, origin, stars FROM samples QUALIFY row_number() OVER (PARTITION BY language, origin ORDER BY stars DESC, sample_id) <= 10",
    "collect_samples": f"""{S} SELECT sample_id, language, extension, md5(c) AS digest, source FROM (
        SELECT *, content AS c, list_last(string_split(filename, '.')) AS extension FROM samples WHERE origin <> 'stackoverflow' AND length(content) >= 100
          QUALIFY row_number() OVER (PARTITION BY language ORDER BY stars DESC, sample_id) <= 30
        UNION ALL SELECT *, content AS c, NULL FROM samples WHERE origin = 'stackoverflow' AND coalesce(try_cast(votes AS INT), 0) >= 3 AND length(content) >= 50
          QUALIFY row_number() OVER (PARTITION BY language ORDER BY sample_id) <= 6)""",
    "tail_split": f"{S}, r AS (SELECT *, row_number() OVER (ORDER BY sample_id DESC) AS r, count(*) OVER () AS n FROM samples) "
                  "SELECT sample_id, language FROM r WHERE r <= floor(n * 0.2) OR floor(n * 0.2) = 0",
    "hash_split": f"{S} SELECT sample_id, CASE WHEN {_hash('sample_id')} % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM samples",
    "stratified_split": f"{S}, r AS ({_ranked('samples', 'sample_id', 'language')}) SELECT sample_id, language, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r",
    "label_stratified_split": f"WITH r AS ({_ranked('labels', 'doc_id', 'quality')}) SELECT doc_id, quality, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r",
    "three_way_split": f"{S}, r AS ({_ranked('samples', 'sample_id', 'language')}) SELECT sample_id, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' WHEN r <= ceil(n * (0.2::DOUBLE + 0.1::DOUBLE)) THEN 'validation' ELSE 'train' END AS split FROM r",
    "kfold": f"{S}, r AS ({_ranked('samples', 'sample_id', 'language')}) SELECT sample_id, (r - 1) % 5 AS fold FROM r",
    "repeated_kfold": f"{S}, a AS ({_ranked('samples', 'sample_id', 'language', '42:1:')}), b AS ({_ranked('samples', 'sample_id', 'language', '42:2:')}) "
                      "SELECT a.sample_id, (a.r - 1) % 3 AS fold_1, (b.r - 1) % 3 AS fold_2 FROM a JOIN b USING (sample_id)",
    "budget_per_source": f"WITH r AS ({_ranked('documents', 'doc_id', 'source')}) SELECT doc_id, source FROM r WHERE r <= 300 // (SELECT count(DISTINCT source) FROM documents)",
    "augment": f"{S}, p AS (SELECT * FROM (SELECT sample_id, language, source, {cleaned('content', 'language')} AS content FROM samples WHERE length(content) > 0) WHERE length(content) >= 50), "
               f"{_augment_sql('p')} SELECT sample_id, parent_id, variant, language, md5(content) AS digest, source FROM augmented",
    "rare_class_augment": f"{S}, c AS (SELECT *, count(*) OVER (PARTITION BY language) AS cn FROM samples), p AS (SELECT * EXCLUDE (cn) FROM c WHERE cn < 60), {_augment_sql('p')} "
                          "SELECT sample_id, parent_id, variant, language, md5(content) AS digest FROM augmented UNION ALL "
                          "SELECT sample_id * 3, sample_id, 'original', language, md5(content) FROM c WHERE cn >= 60",
    "language_training_rows": f"{S}, s(language, k) AS (VALUES {_lang_seeds}) SELECT language, sum(k)::BIGINT AS n FROM (SELECT language, 2 AS k FROM samples UNION ALL SELECT language, k FROM s) GROUP BY language",
    "purpose_training_rows": f"WITH {C} SELECT CASE {_source_arms} ELSE 'Other' END AS purpose, count(*) AS n FROM corpus GROUP BY 1",
    "purpose_training_seeds": f"WITH {C}, n AS (SELECT count(*) AS n FROM corpus WHERE content IS NULL), s(purpose, k) AS (VALUES "
                              f"{', '.join(f'({q(k)}, {len(v)})' for k, v in catalog.PURPOSE_SEEDS.items())}) "
                              "SELECT purpose, k::BIGINT AS n FROM s, n WHERE n.n = 0",
    "purpose_training_set": f"WITH {C} SELECT {keyword_purpose_sql('content', 'language')} AS purpose, language, count(*) AS n FROM corpus GROUP BY ALL",
    "stage_totals": f"WITH {C} SELECT language, count(*) AS n FROM corpus GROUP BY ROLLUP(language)",
    "char_vocabulary": f"WITH {_char_grams_sql('documents', 2, 4)}, terms AS (SELECT doc_id, gram, count(*) AS tf FROM grams GROUP BY ALL) "
                       "SELECT gram, sum(tf)::BIGINT AS total, count(*) AS df FROM terms GROUP BY gram ORDER BY total DESC, gram LIMIT 10000",
    "char_document_frequency": f"WITH {_char_grams_sql('documents', 2, 4)}, terms AS (SELECT doc_id, gram, count(*) AS tf FROM grams GROUP BY ALL) "
                               "SELECT gram, sum(tf)::BIGINT AS total, count(*) AS df FROM terms GROUP BY gram",
    "char_tfidf": f"WITH {_tfidf_sql(_char_grams_sql('documents', 1, 2), 'documents', 10000, 3)} SELECT doc_id, gram, tf, round(weight, 6) AS weight FROM weights",
    "word_tfidf": f"WITH {_tfidf_sql(_word_grams_sql('documents', 1, 2), 'documents', 5000)} SELECT doc_id, gram, tf, round(weight, 6) AS weight FROM weights",
    "word_tfidf_stopped": f"WITH {_tfidf_sql(_word_grams_sql('documents', 1, 4, STOP), 'documents', 20000, 2)} SELECT doc_id, gram, tf, round(weight, 6) AS weight FROM weights",
    "nb_scores": f"{_nb} SELECT doc_id, lang, round(score, 4) AS score FROM scores",
    "nb_predictions": f"{_nb} SELECT doc_id, arg_min(lang, (-round(score, 9), lang)) AS predicted FROM scores GROUP BY doc_id",
    "accuracy": f"{_PRED} SELECT round(avg((declared = predicted)::INT), 6) AS accuracy, count(*) AS support FROM pred",
    "classification_report": _report_sql(_PRED + ",", "declared", "predicted", "pred"),
    "confusion_matrix": _confusion_sql(_PRED + ",", "declared", "predicted", "pred"),
    "label_report": _report_sql("WITH", "quality", "toxic", "labels"),
    "label_confusion": _confusion_sql("WITH", "quality", "toxic", "labels"),
    "accepted_alternatives": f"WITH {C}, k AS (SELECT doc_id, language, {keyword_purpose_sql('content', 'language')} AS kp FROM corpus), "
                             "e AS (SELECT doc_id, CASE WHEN language = 'CSS' THEN 'Styling' ELSE kp END AS expected, CASE WHEN kp = 'Styling' THEN 'UI Styling' ELSE kp END AS predicted FROM k) "
                             f"SELECT doc_id, expected, predicted, expected = predicted OR {_accepted} AS accepted FROM e",
    "pass_rate": f"{_PRED}, e AS (SELECT declared = predicted AS l, declared = predicted AND (expected_purpose = keyword_purpose OR (expected_purpose = 'UI Component' AND keyword_purpose IN ('Frontend'))) AS b FROM pred) "
                 "SELECT round(avg(l::INT) * 100, 6) AS language_accuracy, round(avg(b::INT) * 100, 6) AS combined_accuracy, sum(b::INT)::BIGINT AS passed, count(*) AS total, avg(l::INT) * 100 >= 75 AS gate_met FROM e",
    "example_evaluation": f"{_PRED} SELECT doc_id, declared AS true_language, predicted, declared = predicted AS correct, CASE WHEN length(content) > 50 THEN substr(content, 1, 50) || '...' ELSE content END AS sample FROM pred",
    "distinct_labels": f"WITH {C} SELECT DISTINCT language FROM corpus",
    "nearest_reference": f"WITH {_refs}, s AS (SELECT vec_id, 'label ' || r.label AS name, ord, list_cosine_similarity(embedding::DOUBLE[], ref) AS c FROM embeddings, refs r) "
                         "SELECT vec_id, name AS best_match, round(c, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 12) DESC, ord) = 1",
    "label_cosine": f"WITH {_refs} SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], ref), 6) AS cosine FROM embeddings JOIN refs USING (label)",
}
