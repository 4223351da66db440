"""Cleaning, features and detection: queries and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.corpus import code_corpus, corpus_sql, read
from checks.sql import (
    contains_any, counted, cleaned, folded, m, mi, n, present, q, re2, split_lines, squeeze, strip, sub,
)
from corpuscope import catalog
from corpuscope.functions import text as tx
from corpuscope.operators import cleaning, language as lang, purpose as aim
from corpuscope.sources.pages import ENTITIES, extract_blocks


# --- cleaning -------------------------------------------------------------------------------

def preprocess_code(spark, sf):
    done = code_corpus(spark, sf).select("doc_id", tx.squeeze_code(F.col("content")).alias("text"))
    return done.select("doc_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


def clean_sample(spark, sf):
    done = cleaning.clean(code_corpus(spark, sf))
    return done.select("doc_id", F.length("content").alias("chars"), F.md5("content").alias("digest"))


def clean_sample_limit(spark, sf):
    """The stated limit of 5,000 characters."""
    done = cleaning.clean(code_corpus(spark, sf), max_chars=5000)
    return done.select("doc_id", F.length("content").alias("chars"), F.md5("content").alias("digest"))


def preprocess_batch(spark, sf):
    done = cleaning.preprocess(code_corpus(spark, sf))
    return done.select("doc_id", "language", "source", F.md5("content").alias("digest"))


def size_filters(spark, sf):
    kept = cleaning.large_enough(cleaning.has_content(code_corpus(spark, sf)), most=10_000)
    return kept.select("doc_id", F.length("content").alias("chars"), F.md5("content").alias("digest"),
                       tx.preview(F.col("content")).alias("preview"))


def votes_filter(spark, sf):
    rows = code_corpus(spark, sf).where(cleaning.enough_votes(F.col("votes")) & (F.length("content") >= 50))
    return rows.select("doc_id", cleaning.source_tag(F.lit("stackoverflow"), F.col("origin"), F.col("filename"))
                       .alias("tag"), "votes")


def size_metrics(spark, sf):
    docs = read(spark, sf, "documents")
    return docs.select(
        "doc_id", F.length("text").alias("characters"), tx.newline_lines(F.col("text")).alias("newline_lines"),
        tx.split_lines_count(F.col("text")).alias("lines"))


def dedupe(spark, sf):
    return cleaning.drop_duplicates(read(spark, sf, "documents"), text="text").select("doc_id", "lang", "source", "n_chars")


def tokens(spark, sf):
    table = cleaning.token_table(read(spark, sf, "documents"), text="text")
    return table.groupBy("token").agg(F.count("*").alias("uses"), F.count_distinct("doc_id").alias("documents"))


# --- features and detection -----------------------------------------------------------------

def feature_vector(spark, sf):
    return lang.features(code_corpus(spark, sf)).select(
        "doc_id", "length", "num_lines", *[lang._key(k) for k in catalog.LANGUAGE_PATTERNS])


def page_features(spark, sf):
    return lang.features(read(spark, sf, "pages"), "html").select(
        "page_id", "length", "num_lines", *[lang._key(k) for k in catalog.LANGUAGE_PATTERNS])


PRESENCE = {
    "css_selectors": catalog.CSS_SELECTORS, "script_hints": catalog.SCRIPT_HINTS,
    "script_evidence": catalog.SCRIPT_EVIDENCE, "css_properties": catalog.CSS_PROPERTIES,
    "css_catalogue": catalog.LANGUAGE_PATTERNS["CSS"],
    "typescript_catalogue": catalog.LANGUAGE_PATTERNS["TypeScript"],
}


def presence_counts(spark, sf):
    return lang.presence_counts(code_corpus(spark, sf)).select("doc_id", *PRESENCE)


def predict_language(spark, sf):
    return lang.with_language(code_corpus(spark, sf)).select("doc_id", "language", "language_rule")


def language_histogram(spark, sf):
    return predict_language(spark, sf).groupBy("language", "language_rule").agg(F.count("*").alias("files"))


def page_language(spark, sf):
    return lang.with_language(read(spark, sf, "pages"), "html").select("page_id", "language", "language_rule")


def document_language(spark, sf):
    return lang.with_language(read(spark, sf, "documents"), "text").select("doc_id", "language", "language_rule")


def weighted_language(spark, sf):
    return lang.weighted_language(code_corpus(spark, sf)).select("doc_id", "best_score", "weighted_language")


def editor_guess(spark, sf):
    done = lang.editor_guess(code_corpus(spark, sf))
    return done.select("doc_id", "editor_language", lang.editor_filename(F.col("content")).alias("editor_filename"))


def extension_lookup(spark, sf):
    return lang.with_extension_language(code_corpus(spark, sf)).select(
        "doc_id", "filename", "extension", "extension_language", "editor_extension_language")


def language_overrides(spark, sf):
    code = F.col("content")
    return lang.with_language(code_corpus(spark, sf)).select(
        "doc_id", lang.name_override(code, F.col("language")).alias("by_name"),
        lang.line_end_override(code).alias("by_line_end"), lang.cpp_override(code).alias("cpp"))


def display_gaps(spark, sf):
    return lang.display_gaps(predict_language(spark, sf))


def script_blocks(spark, sf):
    rows = extract_blocks(read(spark, sf, "pages"), "script", least=10)
    return rows.select("page_id", "block_no", F.md5("content").alias("digest"), "source")


def style_block_language(spark, sf):
    rows = extract_blocks(read(spark, sf, "pages"), "style", least=10)
    return lang.with_language(rows).select("page_id", "block_no", "language", "language_rule")


def article_blocks(spark, sf):
    """The element with nested markup: tags dropped, entities resolved."""
    rows = extract_blocks(read(spark, sf, "pages").withColumn(
        "html", F.replace(F.replace("html", F.lit("<article>"), F.lit("<pre>")), F.lit("</article>"), F.lit("</pre>"))),
        "pre")
    return rows.select("page_id", "block_no", F.md5("content").alias("digest"))


# --- purpose ---------------------------------------------------------------------------------

def purpose_labels(spark, sf):
    return aim.with_keyword_purpose(code_corpus(spark, sf)).select("doc_id", "keyword_purpose")


def purpose_from_source(spark, sf):
    return code_corpus(spark, sf).select("doc_id", aim.source_purpose(F.col("source")).alias("purpose"))


def purpose_override(spark, sf):
    return aim.with_purpose(code_corpus(spark, sf)).select("doc_id", "purpose", "confidence")


def missing_class(spark, sf):
    rows = code_corpus(spark, sf).select("doc_id", "content", F.lit("Other").alias("purpose"))
    return aim.complete_classes(rows).groupBy("purpose").agg(
        F.count("*").alias("samples"), F.sum(F.length("content")).alias("chars"))


QUERIES = {f.__name__: f for f in (
    preprocess_code, clean_sample, clean_sample_limit, preprocess_batch, size_filters, votes_filter, size_metrics, dedupe, tokens,
    feature_vector, page_features, presence_counts, predict_language, language_histogram, page_language,
    document_language, weighted_language, editor_guess, extension_lookup, language_overrides, display_gaps,
    script_blocks, style_block_language, article_blocks,
    purpose_labels, purpose_from_source, purpose_override, missing_class)}


# --- SQL ---------------------------------------------------------------------------------------

ANNOTATED = r":\s*(?:string|number|boolean|any|void)"
SHEETLESS = r"function|class\s+\w+|import\s+|export\s+"
RULE_BLOCK = r"(?:\.|#|\*|body|html|div)[^{]*\{\s*[^}]+\}"
RULE_PAIR = r"(?:\.|#|\*|body|html|div)[^{]*\{\s*[^}]*:[^}]*;[^}]*\}"
BARE_NAME = r"(?:\/|\\)?(\w+\.\w+)(?:\'|\"|\s|$)"
QUOTED_NAME = r"[\'\"]([^\'\"\s]+\.\w+)[\'\"]"
KNOWN_NAME = r"[\'\"]([^\'\"\s]+\.(?:css|html|tsx?|jsx?|py|php|json|ya?ml|env|txt))[\'\"](\.)*"


def detection_sql(source: str, key: str, name: str = "detected", text: str = "content", keep: str = "") -> str:
    """CTEs ending in ``name(key, language, language_rule, ...)``."""
    cpp = " OR ".join(m("code", p) for p in catalog.CPP_MARKERS)
    return f"""
{name}_t AS MATERIALIZED (SELECT {key}{keep}, coalesce({text}, '') AS code, {folded(f"coalesce({text}, '')")} AS low,
             {strip(f"coalesce({text}, '')")} AS st FROM {source}),
{name}_u AS MATERIALIZED (SELECT *, lower(regexp_extract(code, {q(re2(BARE_NAME))}, 1)) AS bare,
             regexp_extract(code, {q(re2(QUOTED_NAME))}, 1) AS quoted,
             {present("low", catalog.CSS_SELECTORS)} AS css,
             {present("low", catalog.SCRIPT_HINTS)} AS js,
             {counted("low", catalog.LANGUAGE_PATTERNS["C/C++"])}::DOUBLE AS s_cpp,
             {present("low", catalog.SCRIPT_EVIDENCE)} AS n_js,
             CASE WHEN {mi("low", r"function\s+\w+\s*\(")} THEN 0 ELSE {present("low", catalog.CSS_PROPERTIES)} END AS n_css,
             ({m("low", RULE_BLOCK)} AND NOT {m("low", r"function\s+\w+|const\s+\w+\s*=|let\s+\w+\s*=|var\s+\w+\s*=")}) AS blk
             FROM {name}_t),
{name}_v AS MATERIALIZED (SELECT *, CASE WHEN n_js >= 2 THEN n_js * 1.5 ELSE 0 END::DOUBLE AS s_js,
             (CASE WHEN blk AND n_css > 0 THEN n_css * 1.5 * 1.5 WHEN blk THEN 3.0 ELSE n_css * 1.5 END)::DOUBLE AS s_css
             FROM {name}_u),
{name}_w AS MATERIALIZED (SELECT *, CASE
  WHEN length(st) < 5 THEN '01|Unknown (insufficient code)'
  WHEN ({m("code", r"sx\s*=\s*\{\s*\{")} OR {m("code", r"style\s*=\s*\{\s*\{")})
       AND regexp_matches(code, 'fontWeight|borderBottom|borderColor|padding|margin|color|display') THEN '02|JavaScript'
  WHEN {m("code", r"(?:const|let|var)\s+styles\s*=\s*\{")}
       AND regexp_matches(code, 'display|color|background|margin|padding|font') THEN '03|JavaScript'
  WHEN {mi("low", r"<!DOCTYPE\s+html>|<html|<body|<head|<div\s+class=|<h[1-6]>|<script|<title>")} THEN '04|HTML'
  WHEN {m("code", r"function\s+\w+\s*\([^:]*\)\s*\{")} AND NOT {m("code", ANNOTATED)} THEN '05|JavaScript'
  WHEN {m("code", r"const\s+\w+\s*=\s*\([^:]*\)\s*=>")} AND NOT {m("code", ANNOTATED)} THEN '06|JavaScript'
  WHEN {m("code", r":\s*(?:string|number|boolean|any|void|React\.|\w+Props)")} OR {m("code", r"interface\s+\w+")} THEN '07|TypeScript'
  WHEN starts_with(st, '{{') AND suffix(st, '}}') AND {m("code", r'"\w+":\s*(?:"[^"]*"|[\d\[\{])')} THEN '08|JSON'
  WHEN starts_with(st, '[') AND suffix(st, ']') AND {m("code", r'\{\s*"\w+":')} THEN '09|JSON'
  WHEN {m("code", r"def\s+\w+\s*\([^)]*\):")} OR {m("code", r"class\s+\w+\s*(?:\(.*\))?:")} THEN '10|Python'
  WHEN {m("code", r"^\s*[A-Z_]+=['" + '"' + r"].*['" + '"' + r"]$", multiline=True)} AND {n("code", r"^\s*[A-Z_]+=", multiline=True)} > 1 THEN '11|Configuration'
  WHEN suffix(bare, '.css') THEN '12|CSS' WHEN suffix(bare, '.html') THEN '12|HTML' WHEN suffix(bare, '.py') THEN '12|Python'
  WHEN suffix(bare, '.tsx') OR suffix(bare, '.ts') THEN '12|TypeScript' WHEN suffix(bare, '.js') THEN '12|JavaScript'
  WHEN suffix(bare, '.json') THEN '12|JSON' WHEN suffix(bare, '.yaml') OR suffix(bare, '.yml') THEN '12|YAML'
  WHEN suffix(bare, '.env') OR bare = 'requirements.txt' THEN '12|Configuration'
  WHEN quoted = 'requirements.txt' OR suffix(quoted, '.env') THEN '13|Configuration'
  WHEN suffix(quoted, '.json') THEN '13|JSON' WHEN suffix(quoted, '.yaml') OR suffix(quoted, '.yml') THEN '13|YAML'
  WHEN css >= 2 AND js = 0 THEN '14|CSS'
  WHEN css >= 2 AND {m("code", r"(?:const|let|var)\s+styles|style\s*=\s*\{|sx\s*=\s*\{")} THEN '15|JavaScript'
  WHEN css >= 2 THEN '15|CSS'
  WHEN {m("low", RULE_PAIR)} AND NOT {m("code", SHEETLESS)} THEN '16|CSS'
  WHEN (starts_with(st, '---') OR {m("code", r"^\s*\w+\s*:\s*\w+\s*$", multiline=True)}) AND NOT {m("code", SHEETLESS)}
       AND {n("code", r"^\s*\w+\s*:\s*", multiline=True)} > 1 THEN '17|YAML'
  WHEN greatest(s_cpp, s_js, s_css) >= 2 THEN '23|' || CASE greatest(s_cpp, s_js, s_css) WHEN s_cpp THEN 'C/C++' WHEN s_js THEN 'JavaScript' ELSE 'CSS' END
  WHEN {cpp} THEN '25|C/C++'
  ELSE '26|Unknown' END AS hit FROM {name}_v),
{name} AS MATERIALIZED (SELECT {key}{keep}, code, low, split_part(hit, '|', 2) AS language, 'C1.' || split_part(hit, '|', 1) AS language_rule FROM {name}_w)"""


def _lang_key(language):
    return "lang_" + language.lower().replace("/", "_").replace("+", "p")


def _features_sql(source, key, text):
    counts = ", ".join(f"{counted('low', p)} AS {_lang_key(k)}" for k, p in catalog.LANGUAGE_PATTERNS.items())
    return (f"SELECT {key}, length({text}) AS length, length({text}) - length(replace({text}, chr(10), '')) + 1 AS num_lines, "
            f"{counts} FROM (SELECT *, {folded(text)} AS low FROM {source})")


def _weighted_sql():
    scores = {k: f"round({counted('low', p)} * {float(catalog.LANGUAGE_WEIGHTS.get(k, 1.0))}, 1)"
              for k, p in catalog.LANGUAGE_PATTERNS.items()}
    cols = ", ".join(f"{expr}::DOUBLE AS s{i}" for i, expr in enumerate(scores.values()))
    best = "greatest(" + ", ".join(f"s{i}" for i in range(len(scores))) + ")"
    case = " ".join(f"WHEN s{i} = {best} THEN {q(k)}" for i, k in enumerate(scores))
    return (f"WITH {corpus_sql()}, f AS (SELECT doc_id, {folded('content')} AS low FROM corpus), "
            f"s AS (SELECT doc_id, {cols} FROM f) SELECT doc_id, {best} AS best_score, "
            f"CASE WHEN {best} < 2 THEN 'Unknown' {case} END AS weighted_language FROM s")


def _editor_sql():
    cols, names = [], []
    for language, patterns in catalog.EDITOR_PATTERNS.items():
        flags = {"ascii_words": True, "ignore_case": language == "css"}
        cols.append("(" + " + ".join(f"{m('content', p, **flags)}::INT" for p in patterns) + f") AS s_{language}")
        names.append(f"s_{language}")
    best = f"greatest({', '.join(names)})"
    ext = " ".join(f"WHEN suffix(f, '.{e}') THEN {q(v)}" for e, v in catalog.EDITOR_EXTENSIONS.items())
    case = " ".join(f"WHEN {x} = {best} THEN '{x[2:]}'" for x in names)
    file = re2(r"(?:\/|\\)?(\w+\.\w+)(?:['\"]\s|$)", ascii_words=True)
    quoted = "(?i)[\"'`]([A-Za-z0-9_.-]+\\.[a-z]+)[\"'`]"
    return (f"WITH {corpus_sql()}, e AS (SELECT doc_id, content, lower(regexp_extract(content, {q(file)}, 1)) AS f, "
            f"{', '.join(cols)} FROM corpus) SELECT doc_id, CASE WHEN content = '' THEN 'js' {ext} "
            f"WHEN {best} < 2 THEN 'js' {case} END AS editor_language, "
            f"CASE WHEN length(content) > 10 THEN nullif(regexp_extract(content, {q(quoted)}, 1), '') END AS editor_filename FROM e")


def name_override_sql(code: str, language: str) -> str:
    name = f"lower(regexp_extract({code}, {q(re2(KNOWN_NAME))}, 1))"
    return (f"CASE WHEN suffix({name}, '.css') THEN 'CSS' WHEN suffix({name}, '.ts') OR suffix({name}, '.tsx') THEN 'TypeScript' "
            f"WHEN suffix({name}, '.json') THEN 'JSON' WHEN suffix({name}, '.yaml') OR suffix({name}, '.yml') THEN 'YAML' "
            f"WHEN {name} = 'requirements.txt' OR suffix({name}, '.env') THEN 'Configuration' ELSE {language} END")


def line_end_sql(code: str) -> str:
    return (f"CASE WHEN {m(code, r'\.css$', multiline=True)} THEN 'CSS' WHEN {m(code, r'\.tsx?$', multiline=True)} THEN 'TypeScript' "
            f"WHEN {m(code, r'\.json$', multiline=True)} THEN 'JSON' WHEN {m(code, r'\.ya?ml$', multiline=True)} THEN 'YAML' "
            f"WHEN {m(code, r'\.env$|requirements\.txt$', multiline=True)} THEN 'Configuration' END")


def cpp_sql(code: str) -> str:
    return "(" + " OR ".join(m(code, p) for p in catalog.CPP_MARKERS) + ")"


def override_sql(code: str) -> str:
    squares = r"\[\s*\w+(?:[\^\*]{2}|\s*\*\*\s*)\d+\s+for\s+\w+\s+in\s+range\s*\(\s*\d+\s*\)\s*\]"
    return (f"CASE WHEN {m(code, squares)} THEN 'Math Computation|0.95' "
            f"WHEN {m(code, 'palindrome|Palindrome')} AND {m(code, r'==\s*s\[::-1\]|===.*reverse|reverse\.toString')} THEN 'Algorithm Implementation|0.92' "
            f"WHEN {m(code, 'isPrime|is_prime')} AND {m(code, r'<=\s*1|sqrt')} THEN 'Algorithm Implementation|0.91' END")


def keyword_purpose_sql(code: str, language: str) -> str:
    arms = []
    for purpose, words in catalog.PURPOSE_KEYWORDS.items():
        hit = contains_any(f"lower({code})", words)
        if purpose == "Styling":
            hit += f" AND lower({language}) IN ({', '.join(q(x) for x in catalog.STYLING_LANGUAGES)})"
        arms.append(f"WHEN {hit} THEN {q(purpose)}")
    return f"CASE {' '.join(arms)} ELSE 'Other' END"


def _blocks_sql(tag, html="html"):
    return (f"SELECT page_id, url, generate_subscripts(b, 1) - 1 AS block_no, unnest(b) AS content FROM "
            f"(SELECT page_id, url, regexp_extract_all({html}, {q(f'(?s)<{tag}(?:{chr(92)}s[^>]*)?>(.*?)</{tag}>')}, 1) AS b FROM pages)")


def _entities(col):
    for entity, char in ENTITIES:
        col = f"replace({col}, {q(entity)}, {q(char)})"
    return col


C = corpus_sql()
FULL = f"WITH {C}, {detection_sql('corpus', 'doc_id')}"
WORDISH = r"[\p{L}_][\p{L}\p{N}_]*|\p{N}+|[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_ext_rows = ", ".join(f"({q(e)}, {q(k)})" for k, es in catalog.LANGUAGE_EXTENSIONS.items() for e in es)
_editor_ext = " ".join(f"WHEN {q(e)} THEN {q(v)}" for e, v in catalog.EDITOR_FILENAME_EXTENSIONS.items())
_source_arms = " ".join(f"WHEN contains(source, {q(a)}) THEN {q(b)}" for a, b in catalog.SOURCE_PURPOSES)
_seed_rows = ", ".join(f"({q(k)}, {q(v)})" for k, v in catalog.MISSING_CLASS_SEEDS.items())

ORACLES = {
    "preprocess_code": f"WITH {C}, s AS (SELECT doc_id, {squeeze('content')} AS t FROM corpus) "
                       "SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM s",
    "clean_sample": f"WITH {C}, s AS (SELECT doc_id, {cleaned('content', 'language')} AS t FROM corpus) "
                    "SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM s",
    "clean_sample_limit": f"WITH {C}, s AS (SELECT doc_id, {cleaned('content', 'language', 5000)} AS t FROM corpus) "
                    "SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM s",
    "preprocess_batch": f"WITH {C}, s AS (SELECT doc_id, language, source, {cleaned('content', 'language')} AS t FROM corpus "
                        "WHERE length(content) > 0) SELECT doc_id, language, source, md5(t) AS digest FROM s WHERE length(t) >= 50",
    "size_filters": f"WITH {C}, s AS (SELECT doc_id, substr(content, 1, 10000) AS t FROM corpus WHERE length(content) >= 100) "
                    "SELECT doc_id, length(t) AS chars, md5(t) AS digest, "
                    "CASE WHEN length(t) > 50 THEN substr(t, 1, 50) || '...' ELSE t END AS preview FROM s",
    "votes_filter": f"WITH {C} SELECT doc_id, 'stackoverflow:' || origin || '/' || filename AS tag, votes FROM corpus "
                    "WHERE coalesce(try_cast(votes AS BIGINT), 0) >= 3 AND length(content) >= 50",
    "size_metrics": "SELECT doc_id, length(text) AS characters, len(string_split(text, chr(10))) AS newline_lines, "
                    f"{split_lines('text')} AS lines FROM documents",
    "dedupe": f"WITH p AS (SELECT *, sha256({sub('text', chr(92) + 's+', ' ')}) AS h FROM documents) "
              "SELECT doc_id, lang, source, n_chars FROM p QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1",
    "tokens": f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, {q(WORDISH)})) AS token FROM documents) "
              "SELECT token, count(*) AS uses, count(DISTINCT doc_id) AS documents FROM t GROUP BY token",
    "feature_vector": f"WITH {C} {_features_sql('corpus', 'doc_id', 'content')}",
    "page_features": _features_sql("pages", "page_id", "html"),
    "presence_counts": f"WITH {C} SELECT doc_id, " + ", ".join(f"{present('low', p)} AS {k}" for k, p in PRESENCE.items())
                       + f" FROM (SELECT doc_id, {folded('content')} AS low FROM corpus)",
    "predict_language": f"{FULL} SELECT doc_id, language, language_rule FROM detected",
    "language_histogram": f"{FULL} SELECT language, language_rule, count(*) AS files FROM detected GROUP BY ALL",
    "page_language": f"WITH {detection_sql('pages', 'page_id', text='html')} SELECT page_id, language, language_rule FROM detected",
    "document_language": f"WITH {detection_sql('documents', 'doc_id', text='text')} SELECT doc_id, language, language_rule FROM detected",
    "weighted_language": _weighted_sql(),
    "editor_guess": _editor_sql(),
    "extension_lookup": f"WITH {C}, x(extension, extension_language) AS (VALUES {_ext_rows}), "
                        "f AS (SELECT doc_id, filename, lower(list_last(string_split(filename, '.'))) AS extension FROM corpus) "
                        f"SELECT doc_id, filename, f.extension, extension_language, CASE f.extension {_editor_ext} END AS editor_extension_language "
                        "FROM f LEFT JOIN x ON f.extension = x.extension",
    "language_overrides": f"{FULL} SELECT doc_id, {name_override_sql('code', 'language')} AS by_name, "
                          f"{line_end_sql('code')} AS by_line_end, {cpp_sql('code')} AS cpp FROM detected",
    "display_gaps": f"{FULL}, l(language) AS (VALUES {', '.join('(' + q(x) + ')' for x in catalog.DISPLAY_LANGUAGES)}) "
                    "SELECT language FROM l WHERE language NOT IN (SELECT language FROM detected)",
    "script_blocks": f"SELECT page_id, block_no, md5(content) AS digest, 'page:' || url AS source FROM ({_blocks_sql('script')}) WHERE length(content) >= 10",
    "style_block_language": f"WITH b AS (SELECT * FROM ({_blocks_sql('style')}) WHERE length(content) >= 10), "
                            f"{detection_sql('b', 'page_id', keep=', block_no')} SELECT page_id, block_no, language, language_rule FROM detected",
    "article_blocks": f"WITH b AS (SELECT page_id, block_no, {_entities(chr(39).join(['regexp_replace(content, ', '<[^>]*>', ', ', '', ', ', 'g', ')']))} AS t "
                      f"FROM ({_blocks_sql('article')})) SELECT page_id, block_no, md5(t) AS digest FROM b WHERE length(t) >= 50",
    "purpose_labels": f"WITH {C} SELECT doc_id, {keyword_purpose_sql('content', 'language')} AS keyword_purpose FROM corpus",
    "purpose_from_source": f"WITH {C} SELECT doc_id, CASE {_source_arms} ELSE 'Other' END AS purpose FROM corpus",
    "purpose_override": f"WITH {C}, o AS (SELECT doc_id, {override_sql('content')} AS o FROM corpus) SELECT doc_id, "
                        "coalesce(split_part(o, '|', 1), 'Unknown') AS purpose, coalesce(split_part(o, '|', 2)::DOUBLE, 0.0) AS confidence FROM o",
    "missing_class": f"WITH {C}, s(purpose, content) AS (VALUES {_seed_rows}), r AS (SELECT 'Other' AS purpose, content FROM corpus), "
                     "a AS (SELECT * FROM r UNION ALL SELECT * FROM s WHERE purpose NOT IN (SELECT purpose FROM r) "
                     "AND (SELECT count(DISTINCT purpose) FROM r) < 2) "
                     "SELECT purpose, count(*) AS samples, sum(length(content))::BIGINT AS chars FROM a GROUP BY purpose",
}
