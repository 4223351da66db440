"""The full analysis and the structure job: queries and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.corpus import code_corpus, corpus_sql, read
from checks.sql import contains_any, counted, fold, folded, m, n, present, q, strip, split_lines  # noqa: F401
from checks.text_checks import cpp_sql, detection_sql, keyword_purpose_sql, line_end_sql, name_override_sql, override_sql
from corpuscope import catalog
from corpuscope.operators import confidence as conf, language as lang, purpose as aim, structure
from corpuscope.operators.summary import tidy_model_summary
from corpuscope.plans import analyze as plan

# In these checks the keyword labeller stands in for a trained purpose model, with this probability.
STAND_IN = 0.55


def labelled_corpus(spark, sf):
    rows = aim.with_keyword_purpose(code_corpus(spark, sf))
    return rows.withColumn("model_confidence", F.lit(STAND_IN))


def _analysed(spark, sf):
    return plan.analyze(labelled_corpus(spark, sf), model_purpose="keyword_purpose", model_confidence="model_confidence")


def analyze(spark, sf):
    return _analysed(spark, sf).select(
        "doc_id", "filename", "detected_language", "language_rule", "language", "type", "specific_type", "confidence",
        F.md5("summary").alias("summary_digest"), "ml_analysis", "advanced_ml_used")


def analyze_rules_only(spark, sf):
    return plan.analyze(code_corpus(spark, sf)).select("doc_id", "language", "type", "specific_type", "confidence", "summary")


def analysis_histogram(spark, sf):
    return _analysed(spark, sf).groupBy("language", "type", "language_rule").agg(
        F.count("*").alias("files"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def details(spark, sf):
    return _analysed(spark, sf).select("doc_id", "language", "type", "specific_type")


def confidence(spark, sf):
    return _analysed(spark, sf).select("doc_id", "confidence")


def confidence_bands(spark, sf):
    sure = F.col("confidence")
    return _analysed(spark, sf).groupBy(
        conf.colour(sure).alias("colour"), conf.level(sure).alias("level"), conf.percent_label(sure).alias("label")
    ).agg(F.count("*").alias("files"))


def summary(spark, sf):
    return _analysed(spark, sf).select("doc_id", "summary")


def model_summary(spark, sf):
    """Supplied summaries (turns of the conversations) tidied, with the role as purpose."""
    turns = read(spark, sf, "conversations")
    language = F.when(F.col("turn") % 2 == 0, "Python").otherwise("YAML")
    purpose = F.concat(F.lit("ML "), F.col("role"))
    return turns.select("conv_id", "turn", tidy_model_summary(F.col("text"), language, purpose).alias("summary"))


def page_analysis(spark, sf):
    return plan.analyze(read(spark, sf, "pages"), "html").select("page_id", "language", "type", "confidence", "summary")


def rejects(spark, sf):
    good, bad = plan.split_rejects(code_corpus(spark, sf))
    return bad.groupBy("filename", "error").agg(F.count("*").alias("files")).unionByName(
        good.agg(F.count("*").alias("files")), allowMissingColumns=True)


def report(spark, sf):
    rows = plan.report(labelled_corpus(spark, sf), model_purpose="keyword_purpose", model_confidence="model_confidence")
    a = "analysis."
    return rows.select(
        "doc_id", "filename", "language", "error", F.col(a + "language").alias("final_language"), F.col(a + "type").alias("type"),
        F.col(a + "confidence").alias("confidence"),
        *[F.col(f"{a}ast_analysis.structure.{c}").alias(c) for c in ("functions", "classes", "imports")],
        F.col(a + "ast_analysis.complexity.cyclomatic_complexity").alias("cyclomatic_complexity"))


# --- structure -----------------------------------------------------------------------------------

def _python(spark, sf):
    return plan.python_texts(code_corpus(spark, sf))


def functions(spark, sf):
    return structure.functions_table(_python(spark, sf)).withColumn("args", F.array_join("args", ","))


def classes(spark, sf):
    return structure.classes_table(_python(spark, sf)).withColumn("methods", F.array_join("methods", ","))


def imports(spark, sf):
    return structure.imports_table(_python(spark, sf))


def variables(spark, sf):
    return structure.variables_table(_python(spark, sf))


def complexity(spark, sf):
    return structure.complexity_rows(lang.with_language(code_corpus(spark, sf)))


def basic_structure(spark, sf):
    return structure.basic_structure(read(spark, sf, "pages"), "html").select("page_id", "line_count", "character_count")


def import_frequency(spark, sf):
    return structure.import_frequency(_python(spark, sf))


def complexity_by_language(spark, sf):
    return structure.complexity_by_language(complexity(spark, sf))


QUERIES = {f.__name__: f for f in (
    analysis_histogram, analyze, analyze_rules_only, details, confidence, confidence_bands, summary, model_summary,
    page_analysis, rejects, report, functions, classes, imports, variables, complexity, basic_structure,
    import_frequency, complexity_by_language)}


# --- SQL -------------------------------------------------------------------------------------------

def bare_sql(col: str) -> str:
    """Text with strings and comments emptied, line numbers kept."""
    text = f"replace(replace({col}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    any_one, escaped = r"(?:.|\n)", r"\\(?:.|\n)"
    tokens = "|".join([*(rf"{x * 3}(?:[^\\]|{escaped})*?{x * 3}" for x in "\"'"), *(rf"{x}(?:[^{x}\\\n]|{escaped})*{x}" for x in "\"'"),
                       r"#[^\n]*", r"""[^"'#]+""", any_one])
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, {q(tokens)}), lambda t: CASE WHEN t[1] = '#' THEN '' "
        f"WHEN t[1] NOT IN (chr(34), chr(39)) OR length(t) = 1 THEN t "
        f"WHEN contains(t, chr(10)) THEN '(' || repeat(chr(10), length(t) - length(replace(t, chr(10), ''))) || ')' ELSE t[1] || t[1] END), '')")


def _n_char(col, chars):
    return f"(length({col}) - length(translate({col}, {q(chars)}, '')))"


def flat_sql(code: str, by: str = ".") -> str:
    for _ in range(4):
        code = rf"regexp_replace({code}, '[(\[{{][^()\[\]{{}}]*[)\]}}]', {q(by)}, 'g')"
    return code


TARGETS = r"'^((?:[^=!<>:;]*[^=!<>:;+\-*/%&|^@]=)+)[^=]'"


def logical_sql(source: str = "python", key: str = "doc_id", text: str = "code") -> str:
    """CTEs ending in logical(doc_id, line_no, last_no, indent, suite, kind, code)."""
    word, blanks, end = r"[\p{L}_][\p{L}\p{N}_]*", q(" " + chr(9) + chr(12)), r"(?:[^\p{L}\p{N}_]|$)"
    back = q(chr(92))
    order = "PARTITION BY doc_id ORDER BY line_no, part"
    header = r"^\s*(?:async\s+)?(?:def|class|if|elif|else|for|while|try|except|finally|with|case)" + end
    return f"""
bare AS MATERIALIZED (SELECT {key} AS doc_id, {bare_sql(text)} AS bare FROM {source}),
lines AS MATERIALIZED (SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(bare, chr(10)) AS l FROM bare)),
pieces AS MATERIALIZED (SELECT * FROM (SELECT doc_id, line_no, generate_subscripts(l, 1) AS part, unnest(l) AS code FROM (
   SELECT doc_id, line_no, regexp_extract_all(line, '(?:[^;:]|:=)+[;:]?|[;:]') AS l FROM lines)) WHERE trim(code, {blanks}) <> ''),
depths AS MATERIALIZED (SELECT *, sum({_n_char('code', '([{')} - {_n_char('code', ')]}')}) OVER ({order}) AS depth,
   lag(line_no) OVER ({order}) AS line_before, lag(code[-1]) OVER ({order}) AS end_before FROM pieces),
opens AS MATERIALIZED (SELECT *, coalesce(lag(depth) OVER ({order}), 0) <= 0 AS free FROM depths),
heads AS MATERIALIZED (SELECT *, free AND (line_before IS NULL OR (line_before <> line_no AND NOT (end_before = {back} AND line_before = line_no - 1))) AS heads_line FROM opens),
grp AS MATERIALIZED (SELECT *, count(*) FILTER (heads_line) OVER ({order}) AS logical_no,
   CASE WHEN code[-1] = ':' AND depth <= 0 THEN 1 - len(regexp_extract_all(code, {q(r"(?:^|[^\p{L}\p{N}_])lambda" + end)})) ELSE 0 END AS colons FROM heads),
suites AS MATERIALIZED (SELECT *, first_value(regexp_matches(code, {q(header)})) OVER g AND coalesce(sum(colons) OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS suite,
   first_value(length(code) - length(ltrim(code, {blanks}))) OVER g AS indent FROM grp WINDOW g AS (PARTITION BY doc_id, logical_no ORDER BY line_no, part)),
starts AS MATERIALIZED (SELECT *, heads_line OR (free AND end_before = ';') OR (suite AND NOT lag(suite) OVER (PARTITION BY doc_id, logical_no ORDER BY line_no, part)) AS starts FROM suites),
numbered AS MATERIALIZED (SELECT *, count(*) FILTER (starts) OVER ({order}) AS statement FROM starts),
joined AS MATERIALIZED (SELECT doc_id, min(line_no) AS line_no, max(line_no) AS last_no, min(indent) AS indent, bool_or(suite) AS suite,
   string_agg(CASE WHEN code[-1] = {back} THEN code[:-2] ELSE code END, ' ' ORDER BY line_no, part) AS code FROM numbered GROUP BY doc_id, statement),
logical AS MATERIALIZED (SELECT *, CASE
   WHEN regexp_matches(code, {q(r"^\s*def\s+" + word + r"\s*[(\[]")}) THEN 'def'
   WHEN regexp_matches(code, {q(r"^\s*class\s+[\p{L}_]")}) THEN 'class'
   WHEN regexp_matches(code, {q(r"^\s*import\s+[\p{L}_]")}) THEN 'import'
   WHEN regexp_matches(code, {q(r"^\s*from\s+[\p{L}\p{N}_.]+\s+import" + end)}) THEN 'from'
   WHEN regexp_matches(code, {q(r"^\s*(?:if|elif|for|while|try|with)" + end)}) THEN 'control'
   WHEN regexp_matches({flat_sql('code')}, {TARGETS}) THEN 'assign' ELSE 'other' END AS kind FROM joined)"""


def blocks_sql() -> str:
    """blocks: ends by the next line that is not deeper, parents by the last shallower line before."""
    return """
blocks AS MATERIALIZED (SELECT h.doc_id, h.kind, h.line_no AS start_line, h.code,
   regexp_extract(h.code, '^\\s*(?:def|class)\\s+([\\p{L}\\p{N}_]+)', 1) AS name,
   (SELECT max(b.last_no) FROM logical b WHERE b.doc_id = h.doc_id AND b.line_no >= h.line_no AND b.line_no <
      coalesce((SELECT min(x.line_no) FROM logical x WHERE x.doc_id = h.doc_id AND x.line_no > h.line_no AND x.indent <= h.indent AND NOT x.suite), 1000000000)) AS end_line,
   (SELECT max(p.line_no) FROM logical p WHERE p.doc_id = h.doc_id AND p.line_no < h.line_no AND p.indent < h.indent AND NOT p.suite) AS parent_line
   FROM logical h WHERE h.kind IN ('def', 'class'))""".replace("\\\\", "\\")


def _args_sql():
    inner = flat_sql(r"regexp_replace(code, '^[^(]*\(', '')", "")
    inner = f"split_part({inner}, ')', 1)"
    inner = rf"regexp_replace({inner}, '(?:^|,)\s*\*.*$', '')"
    inner = rf"regexp_replace({inner}, '^.*,\s*/\s*(?:,|$)', '')"
    return rf"array_to_string(regexp_extract_all({inner}, '(?:^|,)\s*([\p{{L}}\p{{N}}_]+)', 1), ',')"


IMPORTS = r"""
items AS MATERIALIZED (SELECT doc_id, line_no AS line, CASE WHEN kind = 'from' THEN regexp_extract(code, '^\s*from\s+\.*([\p{L}\p{N}_.]*)\s+import', 1) ELSE '' END AS module,
   unnest(string_split(CASE WHEN kind = 'from' THEN regexp_extract(code, '^\s*from\s+\S+\s+import\s*\(?([^;)]*)', 1)
                            ELSE regexp_extract(code, '^\s*import\s+([^;]*)', 1) END, ',')) AS item FROM logical WHERE kind IN ('import', 'from')),
named AS MATERIALIZED (SELECT *, regexp_extract(item, '^\s*([\p{L}\p{N}_.*]+)', 1) AS base FROM items),
imports AS MATERIALIZED (SELECT doc_id, CASE WHEN module <> '' THEN module || '.' || base ELSE base END AS name,
   nullif(regexp_extract(item, '\s+as\s+([\p{L}\p{N}_]+)', 1), '') AS alias, line FROM named WHERE base <> '')"""
VARIABLES = rf"""
variables AS MATERIALIZED (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_extract({flat_sql('code')}, {TARGETS}, 1), '='), lambda t: trim(t, {q(" " + chr(9) + chr(12))})),
   lambda t: regexp_full_match(t, '[\p{{L}}_][\p{{L}}\p{{N}}_]*'))) AS name, line_no AS line FROM logical WHERE kind = 'assign')"""


def summary_sql(low, lang_col, aim_col):
    """The summary text for columns of a relation."""
    has = lambda *w: contains_any(low, w)
    libs = ", ".join(q(x) for x in catalog.KNOWN_LIBRARIES)
    emoji = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in catalog.SUMMARY_EMOJI.items())
    p, j = f"{lang_col} = 'Python'", f"{lang_col} = 'JavaScript'"
    api, data = f"{aim_col} = 'API Endpoint'", f"{aim_col} = 'Data Processing'"
    words = f"list_filter(regexp_extract_all({low}, {q('(?:import|from)[' + chr(92) + 's' + chr(92) + 'x0b' + chr(92) + 'x1c-' + chr(92) + 'x1f' + chr(92) + 'x{85}' + chr(92) + 'p{Z}]+([' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+)')}, 1), lambda w: w IN ({libs}))"
    lib = (f"CASE WHEN {p} AND {has('import ')} AND len({words}) > 0 THEN 'The code utilizes ' || array_to_string({words}, ', ') || ' libraries. ' ELSE '' END")
    nf, nc = n(low, r"def\s+\w+|function\s+\w+"), n(low, r"class\s+\w+")
    headline = f"""CASE
      WHEN {api} AND {has('@app.route', '@api')} THEN 'RESTful API endpoint handling HTTP requests' WHEN {api} THEN 'API endpoint for data handling'
      WHEN {data} AND {has('pandas')} THEN 'Data processing script using pandas' WHEN {data} AND {has('array', '[]')} THEN 'Data processing routine for array manipulation'
      WHEN {data} AND {has('sql')} THEN 'SQL-based data processing' WHEN {data} THEN 'General data processing code'
      WHEN {p} AND {has('flask')} THEN 'Flask web application with API endpoints' WHEN {p} AND {has('django')} THEN 'Django web application'
      WHEN {p} AND {has('pandas')} AND {has('data')} THEN 'Python data analysis script using pandas'
      WHEN {p} AND {has('plot', 'matplotlib')} THEN 'Python data visualization script' WHEN {p} THEN 'Python ' || lower({aim_col}) || ' script'
      WHEN {j} AND {has('react')} THEN 'React.js component or application' WHEN {j} AND {has('node')} AND {has('express')} THEN 'Node.js Express server application'
      WHEN {j} AND {has('function')} AND {has('return')} THEN 'JavaScript utility functions' WHEN {j} THEN 'JavaScript application'
      ELSE {lang_col} || ' code for ' || lower({aim_col}) END"""
    how = f"""{lib} || CASE
      WHEN {api} THEN CASE WHEN {has('json')} THEN 'Returns JSON formatted responses. ' ELSE '' END
      WHEN {data} AND {has('pandas')} THEN 'Performs data manipulation with pandas dataframes. '
           || CASE WHEN {has('group')} THEN 'Includes grouping operations for data aggregation. ' ELSE '' END
           || CASE WHEN {has('merge', 'join')} THEN 'Includes data joining/merging operations. ' ELSE '' END
      WHEN {data} AND {has('array', '[]')} THEN '' WHEN {data} AND {has('sql')} THEN 'Executes SQL queries to transform or retrieve data. ' WHEN {data} THEN ''
      WHEN {p} AND {has('flask')} THEN 'Built on the Flask framework providing web routes. '
      WHEN {p} AND {has('django')} THEN 'Implements Django components for web development. '
      WHEN {p} AND {has('pandas')} AND {has('data')} THEN 'Processes and analyzes data with pandas library. '
      WHEN {p} AND {has('plot', 'matplotlib')} THEN 'Creates data visualizations and charts. '
      WHEN {j} AND {has('react')} THEN 'Built with React.js component architecture. '
      WHEN {j} AND {has('node')} AND {has('express')} THEN 'Runs on Node.js with Express framework. '
      WHEN {j} AND {has('function')} AND {has('return')} THEN 'Provides utility functionality through JavaScript functions. ' ELSE '' END"""
    plain = f"""CASE {lang_col} WHEN 'Python' THEN 'The code is written in Python, known for its readability and versatility. '
      WHEN 'JavaScript' THEN 'This JavaScript code can run in browser or Node.js environments. '
      WHEN 'HTML' THEN 'The HTML markup defines structure for web content. ' WHEN 'CSS' THEN 'The CSS provides styling for web elements. '
      ELSE 'This ' || {lang_col} || ' code follows standard language conventions. ' END"""
    notes = f"""CASE WHEN length({low}) > 5000 THEN 'The code is extensive with significant complexity. '
        WHEN length({low}) > 1000 THEN 'The code is moderately complex. ' ELSE '' END
      || CASE WHEN {nf} > 5 THEN 'It contains ' || {nf} || ' functions suggesting a modular design. '
        WHEN {nf} > 0 THEN 'It defines ' || {nf} || ' functions. ' ELSE '' END
      || CASE WHEN {nc} > 0 THEN 'The code implements ' || {nc} || ' classes with object-oriented principles. ' ELSE '' END"""
    return (f"CASE {lang_col} {emoji} ELSE {q(catalog.SUMMARY_EMOJI_DEFAULT)} END || ' Summary: ' || {headline} || '. ' || "
            f"coalesce(nullif({how}, ''), {plain}) || coalesce(nullif({notes}, ''), "
            "'The code follows common patterns for this type of implementation. ')")


def analysis_sql(source, key, text="content", model=None, keep=""):
    """CTEs ending in analysed(key, code, detected_language, language_rule, language, type, specific_type, confidence, summary)."""
    det = detection_sql(source, key, text=text, keep=keep)
    over = override_sql("code")
    mp, mc = model or ("'Unknown'", "0.0")
    balanced = " AND ".join(f"{_n_char('bare', a)} = {_n_char('bare', b)}" for a, b in ("()", "[]", "{}"))
    css, ts = present("low", catalog.LANGUAGE_PATTERNS["CSS"]), present("low", catalog.LANGUAGE_PATTERNS["TypeScript"])
    lo = "lowered"
    algo = " ".join(f"WHEN {contains_any(lo, w)} THEN {q(v)}" for w, v in (
        (("bubble sort", "bubblesort"), "Bubble Sort"), (("quick sort", "quicksort"), "Quick Sort"),
        (("merge sort", "mergesort"), "Merge Sort"), (("binary search",), "Binary Search"),
        (("palindrome",), "Palindrome Check"), (("fibonacci",), "Fibonacci Sequence"), (("is_prime",), "Prime Number Check")))
    return f"""{det},
a1 AS MATERIALIZED (SELECT *, language AS lang0, lower(code) AS lowered, {over} AS o, {bare_sql('code')} AS bare FROM detected),
a2 AS MATERIALIZED (SELECT *, coalesce(split_part(o, '|', 1), {mp}) AS aim0, coalesce(split_part(o, '|', 2)::DOUBLE, {mc}) AS c0,
       {name_override_sql('code', 'lang0')} AS lang1, {line_end_sql('code')} AS lang_end FROM a1),
a3 AS MATERIALIZED (SELECT *, CASE lang1 WHEN 'Configuration' THEN 'Configuration' WHEN 'JSON' THEN 'Data Structure' WHEN 'YAML' THEN 'Configuration' ELSE aim0 END AS aim1,
       CASE WHEN {cpp_sql('code')} THEN 'C/C++' ELSE coalesce(lang_end, lang1) END AS lang3 FROM a2),
a4 AS MATERIALIZED (SELECT *, CASE
   WHEN lang3 = 'JSON' THEN CASE WHEN starts_with({strip('code')}, '[') THEN 'Array|' ELSE 'Object|' END || aim1
   WHEN lang3 = 'Configuration' AND (contains(lowered, 'requirements.txt') OR {m('code', r'^\s*[\w-]+(~=|==|>=|<=|!=|>|<)\d+', multiline=True)}) THEN 'Python Dependencies|Python Dependencies'
   WHEN lang3 = 'Configuration' AND {m('code', r'^\s*[A-Z_]+=', multiline=True)} THEN 'Environment Variables|Environment Configuration'
   WHEN lang3 = 'Configuration' AND {m('code', r'^\s*\[\w+\]', multiline=True)} THEN 'INI Configuration|Application Configuration'
   WHEN lang3 = 'CSS' AND {m('lowered', r'body\s*{')} THEN 'Global styles|Styling'
   WHEN lang3 = 'CSS' AND {m('lowered', r'\.\w+-container')} THEN 'Container styling|Styling'
   WHEN lang3 = 'CSS' AND contains(lowered, '@media') THEN 'Responsive styling|Responsive Design'
   WHEN lang3 = 'CSS' THEN '|Styling'
   WHEN lang3 = 'TypeScript' AND {m('code', r'React\.FC|React\.Component|function\s+\w+\s*\(\s*\{.*\}\s*\)\s*{.*return')} THEN 'React Component|UI Component'
   WHEN lang3 = 'TypeScript' AND {m('code', 'useState|useEffect|useContext|useRef')} THEN 'React Hooks Component|UI Component with Hooks'
   ELSE '|' || aim1 END AS tags FROM a3),
a5 AS MATERIALIZED (SELECT *, split_part(tags, '|', 2) AS type, nullif(split_part(tags, '|', 1), '') AS detail FROM a4),
a6 AS MATERIALIZED (SELECT *, coalesce(detail,
   CASE WHEN type = 'Algorithm Implementation' THEN CASE {algo} END
        WHEN type = 'Math Computation' THEN CASE WHEN {m('lowered', r'\[\s*\w+\s*\*\*\s*\d+\s+for')} OR contains(lowered, 'squares') THEN 'Square Numbers'
             WHEN contains(lowered, 'factorial') THEN 'Factorial' END END) AS specific_type,
   least(1.0, greatest(c0,
     CASE WHEN lang0 <> 'Python' OR ({balanced}) THEN 0.75 ELSE 0 END,
     CASE WHEN lang1 = 'CSS' AND {css} >= 1 THEN 0.7::DOUBLE + {css} * 0.05::DOUBLE ELSE 0 END,
     CASE WHEN lang1 = 'TypeScript' AND {ts} >= 2 THEN 0.7::DOUBLE + {ts} * 0.05::DOUBLE ELSE 0 END,
     CASE WHEN lang_end IS NOT NULL THEN 0.85 ELSE 0 END,
     CASE WHEN lang3 = 'Configuration' AND {strip('code')} <> '' THEN 0.75 ELSE 0 END,
     CASE WHEN lang3 = 'JSON' AND {m('code', r'"[\w-]+"\s*:')} THEN 0.85 ELSE 0 END,
     CASE WHEN lang3 = 'YAML' AND {m('code', r'^\s*\w+\s*:\s*\w+', multiline=True)} THEN 0.80 ELSE 0 END,
     CASE WHEN lang3 = 'CSS' AND {strip('code')} <> '' THEN 0.75 ELSE 0 END,
     CASE WHEN lang3 = 'TypeScript' AND {m('code', r'import\s+React')} THEN 0.80 ELSE 0 END,
     CASE WHEN lang3 = 'Python' AND {m('lowered', r'\[\s*\w+\s*\*\*\s*\d+\s+for\s+\w+\s+in\s+range')} THEN 0.85 ELSE 0 END,
     CASE WHEN type = 'Algorithm Implementation' AND contains(lowered, 'is_palindrome') THEN 0.85 ELSE 0 END,
     CASE WHEN lang3 = 'C/C++' AND contains(lowered, '#include') THEN 0.82 ELSE 0 END))::DOUBLE AS c1 FROM a5),
analysed AS MATERIALIZED (SELECT {key}{keep}, code, lang0 AS detected_language, language_rule, lang3 AS language, type, specific_type,
   round_even(c1 * 100, 0) / 100 AS confidence, {summary_sql('lowered', 'lang3', 'type')} AS summary FROM a6)"""


KP = f"labelled AS (SELECT *, {keyword_purpose_sql('content', 'language')} AS keyword_purpose FROM corpus)"
A = f"WITH {corpus_sql()}, {KP}, {analysis_sql('labelled', 'doc_id', model=('keyword_purpose', str(STAND_IN)), keep=', filename, keyword_purpose')}"
PY = f"WITH {corpus_sql()}, {detection_sql('corpus', 'doc_id')}, python AS (SELECT * FROM detected WHERE language = 'Python'), {logical_sql()}"
COUNTS = f"""{IMPORTS}, {VARIABLES},
counted AS MATERIALIZED (SELECT doc_id, sum((kind = 'def')::INT)::BIGINT AS functions, sum((kind = 'class')::INT)::BIGINT AS classes,
   sum((kind = 'control')::INT)::BIGINT AS control_structures, max(last_no) AS line_count, max(indent) AS max_indent FROM logical GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS imports FROM imports GROUP BY doc_id), nv AS (SELECT doc_id, count(*) AS variables FROM variables GROUP BY doc_id),
complexity AS MATERIALIZED (SELECT d.doc_id, d.language, coalesce(functions, 0) AS functions, coalesce(classes, 0) AS classes, coalesce(imports, 0) AS imports,
   coalesce(variables, 0) AS variables, coalesce(control_structures, 0) AS control_structures, coalesce(line_count, 0) AS line_count,
   coalesce(max_indent, 0) AS max_indent, 1 + coalesce(control_structures, 0) AS cyclomatic_complexity
   FROM detected d LEFT JOIN counted USING (doc_id) LEFT JOIN ni USING (doc_id) LEFT JOIN nv USING (doc_id))"""
_ml_emoji = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in catalog.MODEL_SUMMARY_EMOJI.items())

ORACLES = {
    "analyze": f"{A} SELECT doc_id, filename, detected_language, language_rule, language, type, specific_type, confidence, "
               "md5(summary) AS summary_digest, true AS ml_analysis, false AS advanced_ml_used FROM analysed",
    "analyze_rules_only": f"WITH {corpus_sql()}, {analysis_sql('corpus', 'doc_id')} SELECT doc_id, language, type, specific_type, confidence, summary FROM analysed",
    "analysis_histogram": f"{A} SELECT language, type, language_rule, count(*) AS files, round(avg(confidence), 6) AS mean_confidence FROM analysed GROUP BY ALL",
    "details": f"{A} SELECT doc_id, language, type, specific_type FROM analysed",
    "confidence": f"{A} SELECT doc_id, confidence FROM analysed",
    "confidence_bands": f"{A} SELECT CASE WHEN confidence = 0 THEN 'primary' WHEN confidence >= 0.8 THEN 'success' WHEN confidence >= 0.6 THEN 'primary' "
                        "WHEN confidence >= 0.4 THEN 'warning' ELSE 'error' END AS colour, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS level, "
                        "floor(confidence * 100 + 0.5)::BIGINT || '%' AS label, count(*) AS files FROM analysed GROUP BY ALL",
    "summary": f"{A} SELECT doc_id, summary FROM analysed",
    "model_summary": f"WITH t AS (SELECT *, {strip('text')} AS s, CASE WHEN turn % 2 = 0 THEN 'Python' ELSE 'YAML' END AS l FROM conversations), "
                     "u AS (SELECT *, upper(substr(s, 1, 1)) || lower(substr(s, 2)) AS c FROM t) "
                     f"SELECT conv_id, turn, CASE WHEN l = 'Python' THEN {q(catalog.MODEL_SUMMARY_EMOJI_ML)} ELSE CASE l {_ml_emoji} END END || ' Summary: ' || "
                     "CASE WHEN suffix(c, '.') THEN c ELSE c || '.' END AS summary FROM u",
    "page_analysis": f"WITH {analysis_sql('pages', 'page_id', text='html')} SELECT page_id, language, type, confidence, summary FROM analysed",
    "rejects": f"WITH {corpus_sql()}, s AS (SELECT *, {strip('content')} = '' AS blank FROM corpus) "
               "SELECT filename, 'Empty file' AS error, count(*) AS files FROM s WHERE blank GROUP BY filename UNION ALL SELECT NULL, NULL, count(*) FROM s WHERE NOT blank",
    "report": f"{A}, python AS (SELECT doc_id, code FROM analysed WHERE detected_language = 'Python'), {logical_sql()}, {COUNTS} "
              f"SELECT doc_id, filename, CASE WHEN bad THEN NULL ELSE detected_language END AS language, CASE WHEN bad THEN 'Empty file' END AS error, "
              "CASE WHEN NOT bad THEN a.language END AS final_language, CASE WHEN NOT bad THEN type END AS type, CASE WHEN NOT bad THEN confidence END AS confidence, "
              "CASE WHEN NOT bad THEN functions END AS functions, CASE WHEN NOT bad THEN classes END AS classes, CASE WHEN NOT bad THEN imports END AS imports, "
              f"CASE WHEN NOT bad THEN cyclomatic_complexity END AS cyclomatic_complexity FROM (SELECT *, {strip('code')} = '' AS bad FROM analysed) a "
              "JOIN (SELECT * EXCLUDE (language) FROM complexity) USING (doc_id)",
    "functions": f"{PY}, {blocks_sql()} SELECT doc_id, name, {_args_sql()} AS args, start_line, end_line FROM blocks WHERE kind = 'def'",
    "classes": f"{PY}, {blocks_sql()} SELECT c.doc_id, c.name, coalesce((SELECT string_agg(d.name, ',' ORDER BY d.start_line) FROM blocks d "
               "WHERE d.kind = 'def' AND d.doc_id = c.doc_id AND d.parent_line = c.start_line), '') AS methods, start_line, end_line FROM blocks c WHERE kind = 'class'",
    "imports": f"{PY}, {IMPORTS} SELECT doc_id, name, alias, line FROM imports",
    "variables": f"{PY}, {VARIABLES} SELECT doc_id, name, line FROM variables",
    "complexity": f"{PY}, {COUNTS} SELECT * FROM complexity",
    "basic_structure": f"SELECT page_id, {split_lines('html')} AS line_count, length(html) AS character_count FROM pages",
    "import_frequency": f"{PY}, {IMPORTS} SELECT split_part(name, '.', 1) AS module, count(*) AS imports, count(DISTINCT doc_id) AS texts FROM imports GROUP BY 1",
    "complexity_by_language": f"{PY}, {COUNTS} SELECT language, count(*) AS texts, sum(functions)::BIGINT AS functions, sum(classes)::BIGINT AS classes, "
                              "round(avg(cyclomatic_complexity), 6) AS mean_complexity, max(cyclomatic_complexity) AS max_complexity FROM complexity GROUP BY ROLLUP(language)",
}
