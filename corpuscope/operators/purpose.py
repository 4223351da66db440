"""Purpose: keyword labels, source labels, overrides and detail tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope import catalog
from corpuscope.functions.patterns import any_of, found, occurrences
from corpuscope.functions.text import strip


def _live(keywords: list[str]) -> list[str]:
    """Keywords that can decide: not one with capitals, not one that contains another."""
    lower = list(dict.fromkeys(k for k in keywords if k == k.lower()))
    return [k for k in lower if not any(o != k and o in k for o in lower)]


def with_keyword_purpose(df: DataFrame, text: str = "content", language: str = "language") -> DataFrame:
    """Add ``keyword_purpose``: the first keyword group found in the lower-cased text."""
    low = F.col("_lower")
    df = df.withColumn("_lower", F.lower(F.coalesce(F.col(text), F.lit(""))))
    label = None
    for purpose, keywords in catalog.PURPOSE_KEYWORDS.items():
        hit = any_of([F.contains(low, F.lit(k)) for k in _live(keywords)])
        if purpose == "Styling":
            hit = F.lower(F.coalesce(F.col(language), F.lit(""))).isin(*catalog.STYLING_LANGUAGES) & hit
        label = F.when(hit, purpose) if label is None else label.when(hit, purpose)
    return df.withColumn("keyword_purpose", label.otherwise("Other")).drop("_lower")


def source_purpose(source: Column) -> Column:
    """Purpose told by the source string."""
    label = None
    for fragment, purpose in catalog.SOURCE_PURPOSES:
        hit = F.contains(F.coalesce(source, F.lit("")), F.lit(fragment))
        label = F.when(hit, purpose) if label is None else label.when(hit, purpose)
    return label.otherwise("Other")


def override(text: Column) -> Column:
    """'purpose|confidence' of the three overrides, NULL when none applies."""
    squares = found(text, r"\[\s*\w+[\^\*]{2}\d+\s+for\s+\w+\s+in\s+range\s*\(\s*\d+\s*\)\s*\]") | found(
        text, r"\[\s*\w+\s*\*\*\s*\d+\s+for\s+\w+\s+in\s+range\s*\(\s*\d+\s*\)\s*\]")
    mirrored = (F.contains(text, F.lit("palindrome")) | F.contains(text, F.lit("Palindrome"))) & (
        found(text, r"==\s*s\[::-1\]") | found(text, r"===.*reverse") | F.contains(text, F.lit("reverse.toString")))
    prime = (F.contains(text, F.lit("isPrime")) | F.contains(text, F.lit("is_prime"))) & (
        found(text, r"<=\s*1") | F.contains(text, F.lit("sqrt")))
    return (
        F.when(squares, "Math Computation|0.95")
        .when(mirrored, "Algorithm Implementation|0.92")
        .when(prime, "Algorithm Implementation|0.91")
    )


def with_purpose(
    df: DataFrame, text: str = "content", model_purpose: str | None = None, model_confidence: str | None = None
) -> DataFrame:
    """Add ``purpose`` and ``confidence``: an override, else the model's answer, else ('Unknown', 0)."""
    model = F.col(model_purpose) if model_purpose else F.lit(None).cast("string")
    sure = F.col(model_confidence).cast("double") if model_confidence else F.lit(None).cast("double")
    df = df.withColumn("_over", override(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumns({
        "purpose": F.coalesce(F.substring_index("_over", "|", 1), model, F.lit("Unknown")),
        "confidence": F.coalesce(F.substring_index("_over", "|", -1).cast("double"), sure, F.lit(0.0)),
    }).drop("_over")


def purpose_of_language(language: Column, purpose: Column) -> Column:
    return (
        F.when(language == "Configuration", "Configuration")
        .when(language == "JSON", "Data Structure")
        .when(language == "YAML", "Configuration")
        .otherwise(purpose)
    )


def detail_and_purpose(code: Column, low: Column, language: Column, purpose: Column) -> Column:
    """'detail|purpose' after the per-language rules; the detail part may be empty."""
    pinned = F.contains(low, F.lit("requirements.txt")) | found(
        code, r"^\s*[\w-]+(~=|==|>=|<=|!=|>|<)\d+", multiline=True)
    keep = F.concat(F.lit("|"), purpose)
    tags = (
        F.when(language == "JSON",
               F.concat(F.when(strip(code).startswith("["), "Array|").otherwise("Object|"), purpose))
        .when((language == "Configuration") & pinned, "Python Dependencies|Python Dependencies")
        .when((language == "Configuration") & found(code, r"^\s*[A-Z_]+=", multiline=True),
              "Environment Variables|Environment Configuration")
        .when((language == "Configuration") & found(code, r"^\s*\[\w+\]", multiline=True),
              "INI Configuration|Application Configuration")
        .when((language == "CSS") & found(low, r"body\s*{"), "Global styles|Styling")
        .when((language == "CSS") & found(low, r"\.\w+-container"), "Container styling|Styling")
        .when((language == "CSS") & F.contains(low, F.lit("@media")), "Responsive styling|Responsive Design")
        .when(language == "CSS", "|Styling")
        .when((language == "TypeScript") & (
            F.contains(code, F.lit("React.FC")) | F.contains(code, F.lit("React.Component"))
            | found(code, r"function\s+\w+\s*\(\s*\{.*\}\s*\)\s*{.*return")), "React Component|UI Component")
        .when((language == "TypeScript") & any_of([
            F.contains(code, F.lit(h)) for h in ("useState", "useEffect", "useContext", "useRef")]),
            "React Hooks Component|UI Component with Hooks")
    )
    return tags.otherwise(keep)


def algorithm_detail(low: Column) -> Column:
    def has(*words):
        return any_of([F.contains(low, F.lit(w)) for w in words])

    return (
        F.when(has("bubble sort", "bubblesort"), "Bubble Sort")
        .when(has("quick sort", "quicksort"), "Quick Sort")
        .when(has("merge sort", "mergesort"), "Merge Sort")
        .when(has("binary search"), "Binary Search")
        .when(has("palindrome"), "Palindrome Check")
        .when(has("fibonacci"), "Fibonacci Sequence")
        .when(has("is_prime"), "Prime Number Check")
    )


def math_detail(low: Column) -> Column:
    squares = found(low, r"\[\s*\w+\s*\*\*\s*\d+\s+for") | F.contains(low, F.lit("squares"))
    return F.when(squares, "Square Numbers").when(F.contains(low, F.lit("factorial")), "Factorial")


def function_counts(low: Column) -> tuple[Column, Column]:
    """Functions and classes as the summary counts them, on lower-cased text."""
    heads = F.contains(low, F.lit("def")) | F.contains(low, F.lit("function"))
    return (
        F.when(heads, occurrences(low, r"(?:def|function)\s+\w+")).otherwise(0),
        occurrences(low, r"class\s+\w+"),
    )


def complete_classes(samples: DataFrame, text: str = "content", purpose: str = "purpose") -> DataFrame:
    """Add one example of every absent purpose when the samples have fewer than two classes.

    The gate is a scalar subquery of the plan.
    """
    spark = samples.sparkSession
    seeds = spark.createDataFrame(
        list(catalog.MISSING_CLASS_SEEDS.items()), f"{purpose} string, {text} string"
    )
    present = samples.select(purpose).distinct()
    classes = samples.agg(F.count_distinct(F.col(purpose)))
    missing = seeds.join(present, purpose, "left_anti").where(classes.scalar() < 2)
    return samples.unionByName(missing, allowMissingColumns=True)
