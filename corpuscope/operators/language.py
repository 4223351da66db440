"""Language detection: an ordered rule cascade, two scorers and the file-name look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope import catalog
from corpuscope.functions.patterns import any_of, first_group, fold, found, how_many, occurrences, total
from corpuscope.functions.steps import pinned
from corpuscope.functions.text import folded, newline_lines, strip

ANNOTATION = r":\s*(?:string|number|boolean|any|void)"
NOT_A_SHEET = r"function|class\s+\w+|import\s+|export\s+"
HTML_MARKS = r"<!DOCTYPE\s+html>|<html|<body|<head|<div\s+class=|<h[1-6]>|<script|<title>"
FIRST_FILE = r"(?:\/|\\)?(\w+\.\w+)(?:\'|\"|\s|$)"
QUOTED_FILE = r"[\'\"]([^\'\"\s]+\.\w+)[\'\"]"
QUOTED_KNOWN_FILE = r"[\'\"]([^\'\"\s]+\.(?:css|html|tsx?|jsx?|py|php|json|ya?ml|env|txt))[\'\"](\.)*"


def _arms(rules: list[tuple[str, str, Column]]) -> Column:
    """An ordered CASE giving 'rule|label'; the first condition that holds wins."""
    (rule, label, condition), *rest = rules
    case = F.when(condition, F.lit(f"{rule}|{label}"))
    for rule, label, condition in rest:
        case = case.when(condition, F.lit(f"{rule}|{label}"))
    return case


def with_language(df: DataFrame, text: str = "content", rules_only: bool = True) -> DataFrame:
    """Add ``language`` and ``language_rule``.

    The cascade is evaluated in a few consecutive projections of one stage.  Every later part
    is computed only for rows the earlier parts left open.  With ``rules_only`` an open row
    becomes 'Unknown'; otherwise it stays NULL for a model to fill.
    """
    code = F.col(text)
    low = F.col("_low")
    stripped = F.col("_strip")
    df = df.withColumns({"_low": folded(code), "_strip": strip(code)})

    marks = _arms([
        ("C1.01", "Unknown (insufficient code)", code.isNull() | (F.length(stripped) < 5)),
        ("C1.02", "JavaScript",
         (found(code, r"sx\s*=\s*\{\s*\{") | found(code, r"style\s*=\s*\{\s*\{"))
         & any_of([F.contains(code, F.lit(w)) for w in (
             "fontWeight", "borderBottom", "borderColor", "padding", "margin", "color", "display")])),
        ("C1.03", "JavaScript",
         any_of([found(code, rf"{w}\s+styles\s*=\s*\{{") for w in ("const", "let", "var")])
         & any_of([F.contains(code, F.lit(w)) for w in (
             "display", "color", "background", "margin", "padding", "font")])),
        ("C1.04", "HTML", F.contains(low, F.lit("<")) & found(low, fold(HTML_MARKS))),
        ("C1.05", "JavaScript", found(code, r"function\s+\w+\s*\([^:]*\)\s*\{") & ~found(code, ANNOTATION)),
        ("C1.06", "JavaScript", found(code, r"const\s+\w+\s*=\s*\([^:]*\)\s*=>") & ~found(code, ANNOTATION)),
        ("C1.07", "TypeScript",
         found(code, r":\s*(?:string|number|boolean|any|void|React\.|\w+Props)") | found(code, r"interface\s+\w+")),
        ("C1.08", "JSON",
         stripped.startswith("{") & stripped.endswith("}") & found(code, r'"\w+":\s*(?:"[^"]*"|[\d\[\{])')),
        ("C1.09", "JSON", stripped.startswith("[") & stripped.endswith("]") & found(code, r'\{\s*"\w+":')),
        ("C1.10", "Python", found(code, r"def\s+\w+\s*\([^)]*\):") | found(code, r"class\s+\w+\s*(?:\(.*\))?:")),
        ("C1.11", "Configuration",
         found(code, r"^\s*[A-Z_]+=[\'\"].*[\'\"]$", multiline=True)
         & (occurrences(code, r"^\s*[A-Z_]+=", multiline=True) > 1)),
    ])
    df = df.withColumn("_hit", marks)

    # a point right before a word character is rare and found much faster than a file name
    named = F.when(F.rlike(code, F.lit(r"\.[\p{L}\p{N}_]")), F.lower(first_group(code, FIRST_FILE))).otherwise("")
    df = df.withColumns({
        "_file": F.when(F.col("_hit").isNull(), named),
        "_quoted": F.when(F.col("_hit").isNull() & F.rlike(code, F.lit("['\"]")), first_group(code, QUOTED_FILE)),
    })
    file, quoted = F.col("_file"), F.coalesce(F.col("_quoted"), F.lit(""))
    names = F.coalesce(
        F.col("_hit"),
        _arms([
            *[("C1.12", label, file.endswith(suffix)) for suffix, label in (
                (".css", "CSS"), (".html", "HTML"), (".py", "Python"), (".tsx", "TypeScript"), (".ts", "TypeScript"),
                (".js", "JavaScript"), (".json", "JSON"), (".yaml", "YAML"), (".yml", "YAML"), (".env", "Configuration"))],
            ("C1.12", "Configuration", file == "requirements.txt"),
            ("C1.13", "Configuration", (quoted == "requirements.txt") | quoted.endswith(".env")),
            ("C1.13", "JSON", quoted.endswith(".json")),
            ("C1.13", "YAML", quoted.endswith(".yaml") | quoted.endswith(".yml")),
        ]),
    )
    df = df.withColumn("_hit", names)

    css = how_many([found(low, fold(p)) for p in catalog.CSS_SELECTORS])
    df = df.withColumn("_css", F.when(F.col("_hit").isNull(), css))
    script = how_many([found(low, fold(p)) for p in catalog.SCRIPT_HINTS])
    df = df.withColumn("_script", F.when(F.col("_hit").isNull() & (F.col("_css") >= 2), script))
    styled = (
        found(code, r"(?:const|let|var)\s+styles") | found(code, r"style\s*=\s*\{") | found(code, r"sx\s*=\s*\{")
    )
    sheets = F.coalesce(
        F.col("_hit"),
        _arms([
            ("C1.14", "CSS", (F.col("_css") >= 2) & (F.col("_script") == 0)),
            ("C1.15", "JavaScript", (F.col("_css") >= 2) & styled),
            ("C1.15", "CSS", F.col("_css") >= 2),
            ("C1.16", "CSS",
             found(low, r"(?:\.|#|\*|body|html|div)[^{]*\{\s*[^}]*:[^}]*;[^}]*\}") & ~found(code, NOT_A_SHEET)),
            ("C1.17", "YAML",
             (stripped.startswith("---") | found(code, r"^\s*\w+\s*:\s*\w+\s*$", multiline=True))
             & ~found(code, NOT_A_SHEET)
             & (occurrences(code, r"^\s*\w+\s*:\s*", multiline=True) > 1)),
        ]),
    )
    df = df.withColumn("_hit", sheets)

    # The catalogue loop scores its last language only; the other scores come from evidence lists.
    open_row = F.col("_hit").isNull()
    cpp = total([occurrences(low, fold(p)) for p in catalog.LANGUAGE_PATTERNS["C/C++"]])
    evidence = how_many([found(low, fold(p)) for p in catalog.SCRIPT_EVIDENCE])
    properties = how_many([found(low, fold(p)) for p in catalog.CSS_PROPERTIES])
    rule_block = found(low, r"(?:\.|#|\*|body|html|div)[^{]*\{\s*[^}]+\}") & ~found(
        low, r"function\s+\w+|const\s+\w+\s*=|let\s+\w+\s*=|var\s+\w+\s*=")
    df = df.withColumns({
        "_cpp": F.when(open_row, cpp.cast("double")),
        "_js": F.when(open_row, evidence * 1.5),
        "_prop": F.when(open_row, F.when(~found(low, r"function\s+\w+\s*\("), properties * 1.5).otherwise(0.0)),
        "_block": F.when(open_row, rule_block),
    })
    js = F.when(F.col("_js") >= 3.0, F.col("_js")).otherwise(0.0)
    sheet = (
        F.when(F.col("_block") & (F.col("_prop") > 0), F.col("_prop") * 1.5)
        .when(F.col("_block"), 3.0)
        .otherwise(F.col("_prop"))
    )
    df = df.withColumns({"_js": js, "_prop": sheet})
    cpp, js, sheet = F.col("_cpp"), F.col("_js"), F.col("_prop")
    scored = F.coalesce(
        F.col("_hit"),
        _arms([
            ("C1.23", "C/C++", (cpp >= 2) & (cpp >= js) & (cpp >= sheet)),
            ("C1.23", "JavaScript", (js >= 2) & (js > cpp) & (js >= sheet)),
            ("C1.23", "CSS", (sheet >= 2) & (sheet > cpp) & (sheet > js)),
            ("C1.25", "C/C++", any_of([found(code, p) for p in catalog.CPP_MARKERS])),
        ]),
        *([F.lit("C1.26|Unknown")] if rules_only else []),
    )
    df = df.withColumn("_hit", scored)
    return pinned(df, {
        "language": F.substring_index("_hit", "|", -1),
        "language_rule": F.substring_index("_hit", "|", 1),
    }).drop("_low", "_strip", "_hit", "_file", "_quoted", "_css", "_script", "_cpp", "_js", "_prop", "_block")


def pattern_counts(text: Column) -> dict[str, Column]:
    """Total matches of each language's catalogue patterns."""
    low = folded(text)
    return {
        language: total([occurrences(low, fold(p)) for p in patterns])
        for language, patterns in catalog.LANGUAGE_PATTERNS.items()
    }


def _key(language: str) -> str:
    return "lang_" + language.lower().replace("/", "_").replace("+", "p")


def features(df: DataFrame, text: str = "content") -> DataFrame:
    """Length, line count and the nine catalogue counts."""
    content = F.col(text)
    counts = {_key(language): n for language, n in pattern_counts(F.col("_raw")).items()}
    return (
        df.withColumn("_raw", content)
        .withColumns({"length": F.length(content), "num_lines": newline_lines(content), **counts})
        .drop("_raw")
    )


def presence_counts(df: DataFrame, text: str = "content") -> DataFrame:
    """How many patterns of each list occur at least once."""
    low = F.col("_low")
    lists = {
        "css_selectors": catalog.CSS_SELECTORS,
        "script_hints": catalog.SCRIPT_HINTS,
        "script_evidence": catalog.SCRIPT_EVIDENCE,
        "css_properties": catalog.CSS_PROPERTIES,
        "css_catalogue": catalog.LANGUAGE_PATTERNS["CSS"],
        "typescript_catalogue": catalog.LANGUAGE_PATTERNS["TypeScript"],
    }
    return (
        df.withColumn("_low", folded(F.col(text)))
        .withColumns({name: how_many([found(low, fold(p)) for p in patterns]) for name, patterns in lists.items()})
        .drop("_low")
    )


def weighted_language(df: DataFrame, text: str = "content") -> DataFrame:
    """Weighted catalogue score of every language, best one if it reaches 2, else 'Unknown'."""
    scores = {
        _key(language).replace("lang_", "score_"): F.round(
            n * F.lit(float(catalog.LANGUAGE_WEIGHTS.get(language, 1.0))), 1)
        for language, n in pattern_counts(F.col(text)).items()
    }
    df = df.withColumns(scores)
    best = F.greatest(*[F.col(name) for name in scores])
    df = df.withColumn("best_score", best)
    label = F.when(F.col("best_score") < 2, "Unknown")
    for name, language in zip(scores, catalog.LANGUAGE_PATTERNS):
        label = label.when(F.col(name) == F.col("best_score"), language)
    return df.withColumn("weighted_language", label).drop(*scores)


EDITOR_FILE_JAVA = r"(?<![A-Za-z0-9_])([A-Za-z0-9_]++\.[A-Za-z0-9_]++)(?:['\"][\s\x0b\x{FEFF}\p{Z}]|\z)"


def editor_guess(df: DataFrame, text: str = "content") -> DataFrame:
    """Language guess of the editor: file extension first, then presence scores, 'js' by default."""
    code = F.col(text)
    scores = {}
    for language, patterns in catalog.EDITOR_PATTERNS.items():
        flags = {"ascii_words": True, "ignore_case": language == "css"}
        scores[f"_{language}"] = how_many([found(code, p, **flags) for p in patterns])
    df = df.withColumn("_ext", F.substring_index(F.lower(F.regexp_extract(code, EDITOR_FILE_JAVA, 1)), ".", -1))
    df = df.withColumns({k: F.when(~F.col("_ext").isin(*catalog.EDITOR_EXTENSIONS), v) for k, v in scores.items()})
    df = df.withColumn("_best", F.greatest(*[F.col(k) for k in scores]))
    guess = F.when(code.isNull() | (code == ""), "js")
    for extension, language in catalog.EDITOR_EXTENSIONS.items():
        guess = guess.when(F.col("_ext") == extension, language)
    guess = guess.when(F.col("_best") < 2, "js")
    for name in scores:
        guess = guess.when(F.col(name) == F.col("_best"), name[1:])
    return df.withColumn("editor_language", guess).drop("_ext", "_best", *scores)


def editor_filename(text: Column) -> Column:
    """File name quoted in the text, NULL when there is none or the text is 10 characters or less."""
    name = F.regexp_extract(text, r"(?i)[\"'`]([A-Za-z0-9_.-]+\.[a-z]+)[\"'`]", 1)
    return F.when(F.length(text) > 10, F.nullif(name, F.lit("")))


def extension_of(filename: Column) -> Column:
    return F.lower(F.substring_index(filename, ".", -1))


def extension_table(spark: SparkSession) -> DataFrame:
    """(extension, language): a fixed relation of a few dozen rows."""
    rows = [(ext, language) for language, exts in catalog.LANGUAGE_EXTENSIONS.items() for ext in exts]
    return spark.createDataFrame(rows, "extension string, extension_language string")


def with_extension_language(df: DataFrame, filename: str = "filename") -> DataFrame:
    """Left look-up of the language by file extension, and of the editor's code for it."""
    editor = F.create_map(*[F.lit(x) for kv in catalog.EDITOR_FILENAME_EXTENSIONS.items() for x in kv])
    df = df.withColumn("extension", extension_of(F.col(filename)))
    return df.join(F.broadcast(extension_table(df.sparkSession)), "extension", "left").withColumn(
        "editor_extension_language", F.try_element_at(editor, F.col("extension")))


def name_override(text: Column, language: Column) -> Column:
    """Language told by the first quoted file name with a known extension."""
    name = F.lower(first_group(text, QUOTED_KNOWN_FILE))
    return (
        F.when(name.endswith(".css"), "CSS")
        .when(name.endswith(".ts") | name.endswith(".tsx"), "TypeScript")
        .when(name.endswith(".json"), "JSON")
        .when(name.endswith(".yaml") | name.endswith(".yml"), "YAML")
        .when((name == "requirements.txt") | name.endswith(".env"), "Configuration")
        .otherwise(language)
    )


def line_end_override(text: Column) -> Column:
    """Language told by an extension that ends a line, NULL when there is none."""
    return (
        F.when(found(text, r"\.css$", multiline=True), "CSS")
        .when(found(text, r"\.tsx?$", multiline=True), "TypeScript")
        .when(found(text, r"\.json$", multiline=True), "JSON")
        .when(found(text, r"\.ya?ml$", multiline=True), "YAML")
        .when(found(text, r"\.env$|requirements\.txt$", multiline=True), "Configuration")
    )


def cpp_override(text: Column) -> Column:
    return any_of([found(text, p) for p in catalog.CPP_MARKERS])


def display_gaps(labels: DataFrame, language: str = "language") -> DataFrame:
    """Listed languages no row carries.  The listed side is a fixed table of 18 rows."""
    spark = labels.sparkSession
    listed = spark.createDataFrame([(x,) for x in catalog.DISPLAY_LANGUAGES], "language string")
    seen = labels.select(F.col(language).alias("language")).distinct()
    return listed.join(seen, "language", "left_anti")
