"""A pattern of alternatives is looked for one by one, behind the literal of each."""

from pyspark.sql import functions as F

from corpuscope.functions.patterns import alternatives, found, java

PATTERN = r"function|class\s+\w+|(?:import|from)x\s+|[|]y{1,2}"


def test_bars_outside_of_groups_part_a_pattern():
    assert alternatives(PATTERN) == ["function", r"class\s+\w+", r"(?:import|from)x\s+", r"[|]y{1,2}"]


def test_found_agrees_with_the_whole_pattern(spark):
    pattern = r"\.env$|requirements\.txt$|let\s+\w+\s*="
    texts = ["a.env", "a.env\nb", "a.envy", "requirements.txt\n", "requirementsxtxt", "let  x=", "let", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(found(F.col("t"), pattern, multiline=True), F.rlike("t", F.lit(java(pattern, multiline=True)))).collect()
    assert [r[0] for r in got] == [r[1] for r in got] == [True, True, False, True, False, True, False, False, None]
    plan = df.select(found(F.col("t"), pattern, multiline=True))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Contains") + plan.count("contains") >= 3
