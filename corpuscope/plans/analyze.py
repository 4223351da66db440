"""The full analysis of a corpus as one chain of projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.steps import pinned
from corpuscope.functions.text import folded, is_blank
from corpuscope.operators import confidence as conf
from corpuscope.operators import language as lang
from corpuscope.operators import purpose as aim
from corpuscope.operators.structure import complexity_table, looks_parsable, with_bare_code
from corpuscope.operators.summary import tidy_model_summary, with_summary


def detect(df: DataFrame, text: str = "content", model_language: str | None = None) -> DataFrame:
    """Language by rule; rows no rule settles take the model's answer, if there is one."""
    df = lang.with_language(df, text, rules_only=model_language is None)
    if model_language:
        df = df.withColumns({
            "language": F.coalesce("language", model_language, F.lit("Unknown")),
            "language_rule": F.coalesce("language_rule", F.lit("C1.26")),
        })
    return df


def python_texts(df: DataFrame, text: str = "content", model_language: str | None = None) -> DataFrame:
    """The rows detected as Python.

    A rule calls a text Python only if it holds ``def``, ``class`` or a ``.py`` name, so other
    rows skip the cascade unless a model may answer for them.
    """
    code = F.col(text)
    if model_language is None:
        df = df.where(F.contains(code, F.lit("def")) | F.contains(code, F.lit("class"))
                      | F.contains(F.lower(code), F.lit(".py")))
    return detect(df, text, model_language).where(F.col("language") == "Python")


def analyze(
    df: DataFrame,
    text: str = "content",
    model_language: str | None = None,
    model_purpose: str | None = None,
    model_confidence: str | None = None,
    similarity: str | None = None,
    best_match: str | None = None,
    model_summary: str | None = None,
) -> DataFrame:
    """Add language, type, summary and confidence to every row.  One narrow stage, no shuffle.

    Optional columns carry what trained models say: a language for rows no rule settles, a
    purpose with its probability, the similarity to the nearest reference example, a summary.
    """
    code, low, low_folded = F.col("_code"), F.col("_lower"), F.col("_folded")
    df = detect(df, text, model_language).withColumnRenamed("language", "detected_language")
    df = aim.with_purpose(df, text, model_purpose, model_confidence)
    df = df.withColumn("_code", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({"_lower": F.lower(code), "_folded": folded(code)})

    # language and purpose change step by step; each step is a column of its own
    df = df.withColumn("_lang1", lang.name_override(code, F.col("detected_language")))
    df = df.withColumns({
        "_aim1": aim.purpose_of_language(F.col("_lang1"), F.col("purpose")),
        "_lang_end": lang.line_end_override(code),
    })
    df = df.withColumn(
        "language",
        F.when(lang.cpp_override(code), "C/C++").otherwise(F.coalesce("_lang_end", "_lang1")),
    )
    df = df.withColumn("_tags", aim.detail_and_purpose(code, low, F.col("language"), F.col("_aim1")))
    df = pinned(df, {
        "language": F.col("language"),
        "type": F.substring_index("_tags", "|", -1),
        "_detail": F.substring_index("_tags", "|", 1),
    })
    kind = F.col("type")
    df = df.withColumn("specific_type", F.coalesce(
        F.nullif("_detail", F.lit("")),
        F.when(kind == "Algorithm Implementation", aim.algorithm_detail(low)),
        F.when(kind == "Math Computation", aim.math_detail(low)),
    ))

    df = df.withColumn("_python", F.when(F.col("detected_language") == "Python", code))
    df = with_bare_code(df, "_python", "_bare")
    floors = [
        F.when((F.col("detected_language") != "Python") | looks_parsable(F.col("_bare")), 0.75),
        conf.presence_floor(low_folded, F.col("_lang1")),
        F.when(F.col("_lang_end").isNotNull(), 0.85),
        *conf.pattern_floors(code, low, F.col("language"), kind),
    ]
    if similarity:
        floors.append(F.col(similarity).cast("double"))
    df = df.withColumn("confidence", conf.settle(F.col("confidence"), floors))

    df = with_summary(df, "_lower", "language", "type", "summary")
    if model_summary:
        df = df.withColumn("summary", F.coalesce(
            tidy_model_summary(F.col(model_summary), F.col("language"), kind), F.col("summary")))
    df = df.withColumns({
        "ml_analysis": F.lit(True),
        "advanced_ml_used": F.col(similarity).isNotNull() if similarity else F.lit(False),
    })
    if similarity:
        df = df.withColumn("advanced_analysis", F.when(F.col(similarity).isNotNull(), F.struct(
            (F.col(best_match) if best_match else F.lit(None).cast("string")).alias("best_match"),
            F.col(similarity).cast("double").alias("similarity_score"))))
    return df.drop(
        "_code", "_lower", "_folded", "_python", "_bare", "_lang1", "_lang_end", "_aim1", "_tags", "_detail", "purpose")


def reject_reason(text: Column) -> Column:
    """Why a row cannot be analysed, NULL when it can."""
    return F.when(text.isNull(), "No code provided").when(is_blank(text), "Empty file")


def split_rejects(df: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(good rows, reject rows with ``error``)."""
    marked = df.withColumn("error", reject_reason(F.col(text)))
    return marked.where(F.col("error").isNull()).drop("error"), marked.where(F.col("error").isNotNull())


def report(df: DataFrame, key: str = "doc_id", filename: str = "filename", text: str = "content", **models) -> DataFrame:
    """The nested result row of every file; blank files become error rows.

    The text itself does not cross the one exchange: the analysed columns are joined with the
    per-text structure counts on the unique key.
    """
    good, bad = split_rejects(df, text)
    rows = analyze(good, text, **models)
    kept = [key, filename, "detected_language", "language", "type", "summary", "confidence", "ml_analysis",
            "advanced_ml_used", "specific_type"]
    extra = [c for c in ("advanced_analysis",) if c in rows.columns]
    python = python_texts(good, text, models.get("model_language"))
    counted = complexity_table(python, key, text).select(
        key, "functions", "classes", "imports", "cyclomatic_complexity")
    rows = rows.select(*kept, *extra).join(counted, key, "left")

    def number(name, default=0):
        return F.coalesce(F.col(name), F.lit(default)).cast("int")

    is_python = F.col("detected_language") == "Python"
    analysis = F.struct(
        F.col("language"), F.col("type"), F.col("summary").alias("purpose"), F.col("confidence"),
        F.col("ml_analysis"), F.col("advanced_ml_used"), F.col("specific_type"),
        *[F.col(c) for c in extra],
        F.struct(
            F.struct(number("functions").alias("functions"), number("classes").alias("classes"),
                     number("imports").alias("imports")).alias("structure"),
            F.struct(
                # no parser runs here, so a Python text has no node count
                F.when(~is_python, 0).alias("node_count"), F.lit(0).alias("max_depth"),
                number("functions").alias("function_count"), number("classes").alias("class_count"),
                number("imports").alias("import_count"),
                number("cyclomatic_complexity", 1).alias("cyclomatic_complexity")).alias("complexity"),
        ).alias("ast_analysis"),
    )
    done = rows.select(key, filename, F.col("detected_language").alias("language"), analysis.alias("analysis"),
                       F.lit(None).cast("string").alias("error"))
    return done.unionByName(bad.select(key, filename, "error"), allowMissingColumns=True)
