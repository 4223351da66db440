"""One-paragraph summary text from language, purpose and what the text contains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope import catalog
from corpuscope.functions.patterns import java
from corpuscope.functions.text import strip
from corpuscope.operators.purpose import function_counts


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    values = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(values, key), F.lit(default))


def language_emoji(language: Column) -> Column:
    return _lookup(catalog.SUMMARY_EMOJI, language, catalog.SUMMARY_EMOJI_DEFAULT)


def model_summary_emoji(language: Column, purpose: Column) -> Column:
    learning = (language == "Python") & (
        F.contains(purpose, F.lit("ML")) | F.contains(purpose, F.lit("Machine Learning")))
    return F.when(learning, catalog.MODEL_SUMMARY_EMOJI_ML).otherwise(
        _lookup(catalog.MODEL_SUMMARY_EMOJI, language, catalog.MODEL_SUMMARY_EMOJI_DEFAULT))


def imported_names(low: Column) -> Column:
    """Names after ``import`` / ``from`` in lower-cased text, in order, repeats kept."""
    return F.regexp_extract_all(low, F.lit(java(r"(?:import|from)\s+(\w+)")), F.lit(1))


def known_imports(low: Column) -> Column:
    """The known libraries among the imported names, as 'a, b'.

    The list is filtered as one string, which keeps the expression inside generated code.
    """
    libs = "|".join(catalog.KNOWN_LIBRARIES)
    listed = F.array_join(imported_names(low), ", ")
    kept = F.regexp_replace(listed, rf"(?<![^ ])(?!(?:{libs})(?:,|\z))[^,]+(?:, |\z)", "")
    return F.regexp_replace(kept, r", \z", "")


def with_summary(df: DataFrame, low: str, language: str, purpose: str, out: str = "summary") -> DataFrame:
    """Add the summary; ``low`` names a column holding the lower-cased text."""
    text, lang, aim = F.col(low), F.col(language), F.col(purpose)

    def has(word):
        return F.contains(text, F.lit(word))

    functions, classes = function_counts(text)
    df = df.withColumns({
        "_libs": F.when((lang == "Python") & has("import "), known_imports(text)).otherwise(""),
        "_functions": functions,
        "_classes": classes,
    })
    api, data = aim == "API Endpoint", aim == "Data Processing"
    python, script = lang == "Python", lang == "JavaScript"
    headline = (
        F.when(api & (has("@app.route") | has("@api")), "RESTful API endpoint handling HTTP requests")
        .when(api, "API endpoint for data handling")
        .when(data & has("pandas"), "Data processing script using pandas")
        .when(data & (has("array") | has("[]")), "Data processing routine for array manipulation")
        .when(data & has("sql"), "SQL-based data processing")
        .when(data, "General data processing code")
        .when(python & has("flask"), "Flask web application with API endpoints")
        .when(python & has("django"), "Django web application")
        .when(python & has("pandas") & has("data"), "Python data analysis script using pandas")
        .when(python & (has("plot") | has("matplotlib")), "Python data visualization script")
        .when(python, F.concat(F.lit("Python "), F.lower(aim), F.lit(" script")))
        .when(script & has("react"), "React.js component or application")
        .when(script & has("node") & has("express"), "Node.js Express server application")
        .when(script & has("function") & has("return"), "JavaScript utility functions")
        .when(script, "JavaScript application")
        .otherwise(F.concat(lang, F.lit(" code for "), F.lower(aim)))
    )

    def piece(condition, sentence):
        return F.when(condition, sentence + " ").otherwise("")

    how = (
        F.when(api, piece(has("json"), "Returns JSON formatted responses."))
        .when(data & has("pandas"), F.concat(
            F.lit("Performs data manipulation with pandas dataframes. "),
            piece(has("group"), "Includes grouping operations for data aggregation."),
            piece(has("merge") | has("join"), "Includes data joining/merging operations.")))
        .when(data & (has("array") | has("[]")), "")
        .when(data & has("sql"), "Executes SQL queries to transform or retrieve data. ")
        .when(data, "")
        .when(python & has("flask"), "Built on the Flask framework providing web routes. ")
        .when(python & has("django"), "Implements Django components for web development. ")
        .when(python & has("pandas") & has("data"), "Processes and analyzes data with pandas library. ")
        .when(python & (has("plot") | has("matplotlib")), "Creates data visualizations and charts. ")
        .when(script & has("react"), "Built with React.js component architecture. ")
        .when(script & has("node") & has("express"), "Runs on Node.js with Express framework. ")
        .when(script & has("function") & has("return"),
              "Provides utility functionality through JavaScript functions. ")
        .otherwise("")
    )
    libs = F.when(F.col("_libs") != "", F.concat(F.lit("The code utilizes "), F.col("_libs"), F.lit(" libraries. ")))
    plain = (
        F.when(python, "The code is written in Python, known for its readability and versatility. ")
        .when(script, "This JavaScript code can run in browser or Node.js environments. ")
        .when(lang == "HTML", "The HTML markup defines structure for web content. ")
        .when(lang == "CSS", "The CSS provides styling for web elements. ")
        .otherwise(F.concat(F.lit("This "), lang, F.lit(" code follows standard language conventions. ")))
    )
    size = (
        F.when(F.length(text) > 5000, "The code is extensive with significant complexity. ")
        .when(F.length(text) > 1000, "The code is moderately complex. ")
        .otherwise("")
    )
    count = F.col("_functions").cast("string")
    functions = (
        F.when(F.col("_functions") > 5,
               F.concat(F.lit("It contains "), count, F.lit(" functions suggesting a modular design. ")))
        .when(F.col("_functions") > 0, F.concat(F.lit("It defines "), count, F.lit(" functions. ")))
        .otherwise("")
    )
    classes = F.when(F.col("_classes") > 0, F.concat(
        F.lit("The code implements "), F.col("_classes").cast("string"),
        F.lit(" classes with object-oriented principles. "))).otherwise("")
    df = df.withColumns({
        "_headline": headline,
        "_how": F.concat(F.coalesce(libs, F.lit("")), how),
        "_notes": F.concat(size, functions, classes),
    })
    text = F.concat(
        language_emoji(lang), F.lit(" Summary: "), F.col("_headline"), F.lit(". "),
        F.when(F.col("_how") == "", plain).otherwise(F.col("_how")),
        F.when(F.col("_notes") == "", "The code follows common patterns for this type of implementation. ")
        .otherwise(F.col("_notes")),
    )
    return df.withColumn(out, text).drop("_libs", "_functions", "_classes", "_headline", "_how", "_notes")


def tidy_model_summary(summary: Column, language: Column, purpose: Column) -> Column:
    """A supplied summary: stripped, capitalised, closed with a full stop, with emoji."""
    text = strip(summary)
    text = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2147483646)))
    closed = F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))
    return F.concat(model_summary_emoji(language, purpose), F.lit(" Summary: "), closed)
