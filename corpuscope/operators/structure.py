"""Code structure of Python texts as tables: functions, classes, imports, variables, complexity.

A lexer takes a text apart into strings, comments and code; strings and comments are emptied and
line numbers kept.  Every text is then exploded into pieces of lines, cut behind each semicolon
and colon.  Running sums over the pieces of a text (open brackets, back-slashes, colons of lambdas)
tell where a statement starts: at a line that continues no other, behind a semicolon, and behind
the colon of a header with its suite on the same line.  Block ends and parents come from one
window over (document, indent level).  All windows and aggregates cluster on the document id, so
there is one exchange, of emptied pieces.  A group is never larger than one text.

Known gaps against a full parser: syntax errors, node counts, a target in brackets of its own,
a quote of the same kind inside a formatted string, and brackets nested more than four deep inside
a target or an argument list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.text import count_char, split_lines_count

# a string of three quotes, a string of one, a comment, code, a quote that nothing closes
TOKENS = (
    r"""(?s)\"{3}(?:[^"\\]++|\\.|"(?!""))*+\"{3}|'{3}(?:[^'\\]++|\\.|'(?!''))*+'{3}"""
    r"""|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|#[^\n]*+|[^"'#]++|["']"""
)
PIECES = r"(?:[^;:]++|:=)++[;:]?|[;:]"
TARGETS = r"^((?:[^=!<>:;]*[^=!<>:;+\-*/%&|^@]=)+)[^=]"
CONTROL = r"^\s*(?:if|elif|for|while|try|with)(?![\p{L}\p{N}_])"
HEADER = r"^\s*(?:async\s+)?(?:def|class|if|elif|else|for|while|try|except|finally|with|case)(?![\p{L}\p{N}_])"
LAMBDA = r"(?<![\p{L}\p{N}_])lambda(?![\p{L}\p{N}_])"
BLANKS = " \t\f"


def with_bare_code(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the text with unix line ends and with strings and comments emptied; line numbers kept.

    A string over several lines becomes a bracket pair around as many newlines.
    """
    unix = F.replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    df = df.withColumn(out, unix)

    def emptied(token: Column) -> Column:
        first, size = F.substring(token, 1, 1), F.length(token)
        lines = count_char(token, "\n")
        return (
            F.when(first == "#", F.lit(""))
            .when(~first.isin('"', "'") | (size == 1), token)
            .when(lines > 0, F.concat(F.lit("("), F.repeat(F.lit("\n"), lines), F.lit(")")))
            .otherwise(F.concat(first, first))
        )

    tokens = F.regexp_extract_all(out, F.lit(TOKENS), F.lit(0))
    quoted = F.rlike(F.col(out), F.lit("[\"'#]"))
    return df.withColumn(out, F.when(quoted, F.array_join(F.transform(tokens, emptied), "")).otherwise(F.col(out)))


def looks_parsable(bare: Column) -> Column:
    """Brackets of each kind balance in a text whose strings and comments are emptied."""
    return (
        (count_char(bare, "(") == count_char(bare, ")"))
        & (count_char(bare, "[") == count_char(bare, "]"))
        & (count_char(bare, "{") == count_char(bare, "}"))
    )


def _indent(code: Column) -> Column:
    return F.length(code) - F.length(F.ltrim(code, F.lit(BLANKS)))


def _flat(code: Column, by: str = ".") -> Column:
    """Code with ``by`` for each bracket pair and what stands in it, innermost first."""
    for _ in range(4):
        code = F.regexp_replace(code, r"[(\[{][^()\[\]{}]*[)\]}]", by)
    return code


def _pieces(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, part, code, _delta): parts of lines, each up to a semicolon or colon."""
    line = F.col("_line")
    parts = F.when(F.contains(line, F.lit(";")) | F.contains(line, F.lit(":")), F.regexp_extract_all(line, F.lit(PIECES), F.lit(0)))
    return (
        with_bare_code(df.select(key, F.col(text).alias("_text")), "_text", "_bare")
        .select(key, F.posexplode_outer(F.split("_bare", "\n")).alias("_pos", "_line"))
        .where(F.btrim(line, F.lit(BLANKS)) != "")
        .select(key, (F.col("_pos") + 1).alias("line_no"), F.posexplode(F.coalesce(parts, F.array(line))).alias("part", "code"))
        .where(F.btrim(F.col("code"), F.lit(BLANKS)) != "")
        .withColumn("_delta", count_char(F.translate("code", "([{", "((("), "(") - count_char(F.translate("code", ")]}", ")))"), ")"))
    )


def logical_lines(df: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """(key, line_no, part, last_no, indent, suite, kind, code): one row per statement.

    ``kind`` is def, class, import, from, control, assign or other.  ``part`` orders the statements of
    a line, ``indent`` is that of the line, ``suite`` tells a statement behind a header on its line.
    """
    in_order = Window.partitionBy(key).orderBy("line_no", "part")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    running = in_order.rowsBetween(Window.unboundedPreceding, 0)
    code, opened = F.col("code"), F.col("_opened")
    ends_line = F.col("line_no") != F.lag("line_no").over(in_order)
    goes_on = F.lag(F.endswith(code, F.lit("\\"))).over(in_order) & (F.col("line_no") == F.lag("line_no").over(in_order) + 1)
    after_semicolon = F.lag(F.endswith(code, F.lit(";"))).over(in_order)
    pieces = _pieces(df, key, text).withColumns({
        "_opened": F.coalesce(F.sum("_delta").over(before), F.lit(0)),
        "_new_line": F.coalesce(ends_line & ~goes_on, F.lit(True)),
        "_after": F.coalesce(after_semicolon, F.lit(False)),
    })
    # a logical line: its header, its indent, and the colons outside of brackets met in it
    colon = F.endswith(code, F.lit(":")) & (opened + F.col("_delta") <= 0)
    pieces = pieces.withColumns({
        "_new_line": F.col("_new_line") & (opened <= 0),
        "_colons": F.when(colon, 1 - F.regexp_count(code, F.lit(LAMBDA))).otherwise(0),
    })
    new_line = F.col("_new_line")
    pieces = pieces.withColumns({
        "_met": F.sum("_colons").over(running),
        "_met_before": F.last(F.when(new_line, F.coalesce(F.sum("_colons").over(before), F.lit(0))), ignorenulls=True).over(running),
        "_header": F.last(F.when(new_line, F.rlike(code, F.lit(HEADER))), ignorenulls=True).over(running),
        "indent": F.last(F.when(new_line, _indent(code)), ignorenulls=True).over(running),
    })
    behind = F.col("_met") - F.col("_met_before") - F.col("_colons")
    pieces = pieces.withColumn("suite", F.col("_header") & (behind > 0))
    in_suite_before = F.coalesce(F.lag("suite").over(in_order), F.lit(False))
    pieces = pieces.withColumn("_start", new_line | ((opened <= 0) & F.col("_after")) | (F.col("suite") & ~in_suite_before))
    lead = F.when(F.col("_start"), F.rlike(code, F.lit(r"^\s*(?:def|class|import|from)(?![\p{L}\p{N}_])")))
    pieces = pieces.withColumns({
        "_first": F.last(F.when(F.col("_start"), F.struct("line_no", "part")), ignorenulls=True).over(running),
        "_whole": F.last(lead, ignorenulls=True).over(running),
    })
    bare = F.when(F.endswith(code, F.lit("\\")), F.left(code, F.length(code) - 1)).otherwise(code)
    # of a statement without names to list, lines wholly inside its brackets are left out
    outside = (opened <= 0) | (opened + F.col("_delta") <= 0) | (F.col("line_no") == F.col("_first.line_no"))
    kept = F.array_sort(F.collect_list(F.when(F.col("_whole") | outside, F.struct("line_no", "part", bare.alias("code")))))
    statements = (
        pieces.groupBy(key, "_first")
        .agg(
            F.max("line_no").alias("last_no"),
            F.min("indent").alias("indent"),
            F.max("suite").alias("suite"),
            F.array_join(F.transform(kept, lambda p: p["code"]), " ").alias("code"),
        )
        .select(key, "_first.line_no", "_first.part", "last_no", "indent", "suite", "code")
    )
    kind = (
        F.when(F.rlike(code, F.lit(r"^\s*def\s+[\p{L}_][\p{L}\p{N}_]*\s*[(\[]")), "def")
        .when(F.rlike(code, F.lit(r"^\s*class\s+[\p{L}_]")), "class")
        .when(F.rlike(code, F.lit(r"^\s*import\s+[\p{L}_]")), "import")
        .when(F.rlike(code, F.lit(r"^\s*from\s+[\p{L}\p{N}_.]+\s+import(?![\p{L}\p{N}_])")), "from")
        .when(F.rlike(code, F.lit(CONTROL)), "control")
        .when(F.rlike(_flat(code), F.lit(TARGETS)), "assign")
        .otherwise("other")
    )
    return statements.withColumn("kind", kind)


def blocks(logical: DataFrame, key: str = "doc_id") -> DataFrame:
    """def and class rows with ``end_line`` and ``parent_line`` (line of the enclosing statement).

    A statement that opens its line is copied to each header indent of its text that it can close.
    Within one (text, indent) group the next row closes a header, and the last shallower row before
    it is its parent.
    """
    is_header = F.col("kind").isin("def", "class")
    whole = Window.partitionBy(key)
    by_line = whole.orderBy("line_no", "part")
    marked = logical.withColumns({
        "_levels": F.collect_set(F.when(is_header, F.col("indent"))).over(whole),
        "_end_before": F.lag("last_no").over(by_line),
        "_end_of_text": F.max("last_no").over(whole),
    })
    per_level = (
        marked.where(F.size("_levels") > 0)
        .withColumn("_level", F.explode("_levels"))
        .where((F.col("indent") <= F.col("_level")) & ~F.col("suite"))
    )
    at_level = Window.partitionBy(key, "_level").orderBy("line_no", "part")
    before = at_level.rowsBetween(Window.unboundedPreceding, -1)
    return (
        per_level.withColumns({
            "end_line": F.coalesce(F.lead("_end_before").over(at_level), F.col("_end_of_text")),
            "parent_line": F.last(
                F.when(F.col("indent") < F.col("_level"), F.col("line_no")), ignorenulls=True).over(before),
        })
        .where(is_header & (F.col("indent") == F.col("_level")))
        .select(key, "kind", F.col("line_no").alias("start_line"), "end_line", "parent_line", "code",
                F.regexp_extract("code", r"^\s*(?:def|class)\s+([\p{L}\p{N}_]+)", 1).alias("name"))
    )


def argument_names(header: Column) -> Column:
    """Positional argument names of a ``def`` line."""
    inner = _flat(F.regexp_replace(header, r"^[^(]*\(", ""), "")
    inner = F.substring_index(inner, ")", 1)
    inner = F.regexp_replace(inner, r"(?:^|,)\s*\*.*$", "")
    inner = F.regexp_replace(inner, r"^.*,\s*/\s*(?:,|$)", "")
    return F.regexp_extract_all(inner, F.lit(r"(?:^|,)\s*([\p{L}\p{N}_]+)"), F.lit(1))


def functions_table(df: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    found = blocks(logical_lines(df, key, text), key).where(F.col("kind") == "def")
    return found.select(key, "name", argument_names(F.col("code")).alias("args"), "start_line", "end_line")


def classes_table(df: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """Classes with the names of the functions that are their direct children, in line order."""
    found = blocks(logical_lines(df, key, text), key)
    # a class row opens its own group and its direct functions fall into the same one
    owner = F.when(F.col("kind") == "class", F.col("start_line")).otherwise(F.col("parent_line"))
    grouped = found.select(key, "kind", "name", "start_line", "end_line", "parent_line", owner.alias("_owner"))
    members = F.array_sort(F.collect_list(F.when(F.col("kind") == "def", F.struct("start_line", "name"))))
    is_class = F.col("kind") == "class"
    return (
        grouped.where(F.col("_owner").isNotNull())
        .groupBy(key, "_owner")
        .agg(
            F.max(F.when(is_class, F.col("name"))).alias("name"),
            F.transform(members, lambda m: m["name"]).alias("methods"),
            F.max(F.when(is_class, F.col("end_line"))).alias("end_line"),
        )
        .where(F.col("name").isNotNull())
        .select(key, "name", "methods", F.col("_owner").alias("start_line"), "end_line")
    )


def imports_from(logical: DataFrame, key: str = "doc_id") -> DataFrame:
    plain = F.regexp_extract("code", r"^\s*import\s+([^;]*)", 1)
    module = F.regexp_extract("code", r"^\s*from\s+\.*([\p{L}\p{N}_.]*)\s+import", 1)
    listed = F.regexp_extract("code", r"^\s*from\s+\S+\s+import\s*\(?([^;)]*)", 1)
    rows = logical.where(F.col("kind").isin("import", "from")).select(
        key, F.col("line_no").alias("line"),
        F.when(F.col("kind") == "from", module).otherwise("").alias("_module"),
        F.explode(F.split(F.when(F.col("kind") == "from", listed).otherwise(plain), ",")).alias("_item"),
    )
    name = F.regexp_extract("_item", r"^\s*([\p{L}\p{N}_.*]+)", 1)
    alias = F.nullif(F.regexp_extract("_item", r"\s+as\s+([\p{L}\p{N}_]+)", 1), F.lit(""))
    rows = rows.withColumns({"_name": name, "alias": alias}).where(F.col("_name") != "")
    full = F.when(F.col("_module") != "", F.concat("_module", F.lit("."), "_name")).otherwise(F.col("_name"))
    return rows.select(key, full.alias("name"), "alias", "line")


def imports_table(df: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    return imports_from(logical_lines(df, key, text), key)


def _targets(code: Column) -> Column:
    """Names that are whole targets of an assignment."""
    targets = F.split(F.regexp_extract(_flat(code), TARGETS, 1), "=")
    return F.filter(F.transform(targets, lambda t: F.btrim(t, F.lit(BLANKS))), lambda t: F.rlike(t, F.lit(r"^[\p{L}_][\p{L}\p{N}_]*$")))


def variables_table(df: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    return (
        logical_lines(df, key, text).where(F.col("kind") == "assign")
        .select(key, F.explode(_targets(F.col("code"))).alias("name"), F.col("line_no").alias("line"))
    )


def complexity_table(df: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """One row per text that has at least one statement."""
    def number(kind):
        return F.sum((F.col("kind") == kind).cast("long"))

    items = (
        F.when(F.col("kind") == "import", F.regexp_extract("code", r"^\s*import\s+([^;]*)", 1))
        .when(F.col("kind") == "from", F.regexp_extract("code", r"^\s*from\s+\S+\s+import\s*\(?([^;)]*)", 1))
    )
    names = F.regexp_count(items, F.lit(r"(?:^|,)\s*[\p{L}\p{N}_.*]+"))
    return (
        logical_lines(df, key, text)
        .groupBy(key)
        .agg(
            number("def").alias("functions"),
            number("class").alias("classes"),
            F.coalesce(F.sum(names), F.lit(0)).cast("long").alias("imports"),
            F.sum(F.when(F.col("kind") == "assign", F.size(_targets(F.col("code")))).otherwise(0))
            .cast("long").alias("variables"),
            number("control").alias("control_structures"),
            (number("control") + 1).alias("cyclomatic_complexity"),
            F.max("last_no").cast("long").alias("line_count"),
            F.max("indent").cast("long").alias("max_indent"),
        )
    )


def basic_structure(df: DataFrame, text: str = "content") -> DataFrame:
    """Line and character counts, for texts that are not Python."""
    return df.withColumns({
        "line_count": split_lines_count(F.col(text)),
        "character_count": F.length(text),
    })


def complexity_rows(df: DataFrame, key: str = "doc_id", text: str = "content", language: str = "language") -> DataFrame:
    """The complexity row of every text, with defaults for texts without Python structure.

    Texts other than Python never enter the line explosion.
    """
    counted = complexity_table(df.where(F.col(language) == "Python"), key, text)
    rows = df.select(key, language).join(counted, key, "left")
    zero = ["functions", "classes", "imports", "variables", "control_structures", "line_count", "max_indent"]
    return rows.select(
        key, language,
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in zero],
        F.coalesce(F.col("cyclomatic_complexity"), F.lit(1)).alias("cyclomatic_complexity"),
    )


def import_frequency(df: DataFrame, key: str = "doc_id", text: str = "content") -> DataFrame:
    """Top-level module, import rows and importing texts."""
    return (
        imports_table(df, key, text)
        .groupBy(F.substring_index("name", ".", 1).alias("module"))
        .agg(F.count("*").alias("imports"), F.count_distinct(key).alias("texts"))
    )


def complexity_by_language(rows: DataFrame, language: str = "language") -> DataFrame:
    """Roll-up of complexity rows per language with a grand total (NULL language)."""
    return rows.rollup(language).agg(
        F.count("*").alias("texts"),
        F.sum("functions").alias("functions"),
        F.sum("classes").alias("classes"),
        F.round(F.avg("cyclomatic_complexity"), 6).alias("mean_complexity"),
        F.max("cyclomatic_complexity").alias("max_complexity"),
    )
