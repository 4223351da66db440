"""Hand-derived results of the rules on small texts."""

import pytest
from pyspark.sql import functions as F

from corpuscope.operators import evaluate, language, purpose
from corpuscope.plans.analyze import analyze, report

CASES = [
    # text, rule, language
    ("x=1", "C1.01", "Unknown (insufficient code)"),
    ("   \n\t  ", "C1.01", "Unknown (insufficient code)"),
    ("<Box sx={{ padding: 2 }} />", "C1.02", "JavaScript"),
    ("<p style = { { opacity: 1, fontWeight: 2 } }/>", "C1.02", "JavaScript"),
    ("let styles = { a: { margin: 1 } }", "C1.03", "JavaScript"),
    ("<!doctype   html><p>x</p>", "C1.04", "HTML"),
    ("text <H3>head</H3>", "C1.04", "HTML"),
    ("function add(a, b) { return a }", "C1.05", "JavaScript"),
    ("const add = (a, b) => a", "C1.06", "JavaScript"),
    ("function add(a: number) { return a }", "C1.07", "TypeScript"),
    ("interface Büro extends X", "C1.07", "TypeScript"),
    ('{"a": 1, "b": [2]}', "C1.08", "JSON"),
    ('[{"a": 1}]', "C1.09", "JSON"),
    ("def é(x):\n    return x", "C1.10", "Python"),
    ("class Box:\n    pass", "C1.10", "Python"),
    ("A_KEY='x'\nB_KEY=2\n", "C1.11", "Configuration"),
    ("open main.CSS now", "C1.12", "CSS"),
    ("see requirements.txt", "C1.12", "Configuration"),
    ("see app.tsx", "C1.12", "TypeScript"),
    ("ends with conf.yml\n", "C1.12", "YAML"),
    ("load '/etc/.env' now", "C1.13", "Configuration"),
    ("body { x } .row { y }", "C1.14", "CSS"),
    ("return `body { margin: 4px }`", "C1.15", "CSS"),
    ("var styles; `body { margin: 4px }`", "C1.15", "JavaScript"),
    ("div { float: left; }", "C1.16", "CSS"),
    ("name: demo\nkind: list\n", "C1.17", "YAML"),
    ("document.a; window.b; x", "C1.23", "JavaScript"),
    ("color: red, width: 3", "C1.23", "CSS"),
    ("html { nothing }", "C1.23", "CSS"),
    ("using namespace std; int main (x)", "C1.23", "C/C++"),
    ("cout << total;", "C1.25", "C/C++"),
    ("only some words here", "C1.26", "Unknown"),
]


@pytest.fixture(scope="module")
def detected(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, content string")
    return {r.id: r for r in language.with_language(rows).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_language_rule(detected, i):
    text, rule, label = CASES[i]
    assert (detected[i].language_rule, detected[i].language) == (rule, label), text


def test_purpose_labels(spark):
    cases = [
        ("binary tree", "Python", "Algorithm Implementation"), ("<div>", "HTML", "UI Component"),
        ("a { color: red }", "CSS", "Styling"), ("a { color: red }", "Java", "Other"),
        ("call the endpoint", "Go", "API"), ("use NumPy", "Python", "Data Processing"),
        ("a helper", "Go", "Utility"), ("mongodb", "Go", "Database"), ("with jest", "Go", "Testing"),
        ("useState", "Go", "UI Component"),  # holds 'state' once lower-cased
        ("nothing", "Go", "Other"), (None, None, "Other"),
    ]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "id int, content string, language string")
    got = {r.id: r.keyword_purpose for r in purpose.with_keyword_purpose(rows).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_analysis_of_known_samples(spark):
    """Four known texts with their expected language; purposes follow from the overrides and the language."""
    cases = {
        "py": "\ndef digits(number):\n    total = 0\n    while number:\n        total += number % 10\n        number //= 10\n    return total\n",
        "js": "\nfunction longest(words) {\n    let best = '';\n    for (const w of words) { if (w.length > best.length) best = w; }\n    return best;\n}\n",
        "css": "\n.side-note {\n    color: teal;\n    line-height: 2;\n}\n",
        "jsx": "\nfunction Button() {\n  return (<button style={{ color: 'white' }}>Go</button>);\n}\n",
    }
    rows = spark.createDataFrame(list(cases.items()), "name string, content string")
    got = {r.name: r for r in analyze(rows).collect()}
    assert [got[k].language for k in cases] == ["Python", "JavaScript", "CSS", "JavaScript"]
    assert got["css"].type == "Styling" and got["css"].confidence == 0.75
    assert got["py"].confidence == 0.75 and got["py"].type == "Unknown"
    assert got["py"].summary.startswith("🐍 Summary: Python unknown script. The code is written in Python")
    right = F.col("language") == F.col("want")
    scored = analyze(rows).join(spark.createDataFrame(
        [("py", "Python"), ("js", "JavaScript"), ("css", "CSS"), ("jsx", "HTML")], "name string, want string"), "name")
    rate = evaluate.pass_rate(scored, right, F.lit(True)).first()
    assert (rate.language_accuracy, rate.passed, rate.total, rate.gate_met) == (75.0, 3, 4, True)


@pytest.mark.parametrize("text, language_, type_, detail, confidence", [
    ("squares = [x**2 for x in range(10)]\ndef f(x): return x", "Python", "Math Computation", "Square Numbers", 0.95),
    ("def is_palindrome(s):\n    return s == s[::-1]", "Python", "Algorithm Implementation", "Palindrome Check", 0.92),
    ("def is_prime(n):\n    return n <= 1", "Python", "Algorithm Implementation", "Prime Number Check", 0.91),
    # the first line ends with the file name, which is a floor of 0.85
    ("# requirements.txt\nflask>=1\n", "Configuration", "Python Dependencies", "Python Dependencies", 0.85),
    ("# requirements.txt file\nflask>=1\n", "Configuration", "Python Dependencies", "Python Dependencies", 0.75),
    ("A_KEY='x'\nB_KEY=2\n", "Configuration", "Environment Configuration", "Environment Variables", 0.75),
    ("see local.env \n[core]\n", "Configuration", "Application Configuration", "INI Configuration", 0.75),
    ('[{"a": 1}]', "JSON", "Data Structure", "Array", 0.85),
    ('{"a": 1}', "JSON", "Data Structure", "Object", 0.85),
    ("body { margin: 0; }\n.a { color: #fff; }", "CSS", "Styling", "Global styles", 0.85),
    ("@media x { .a { float: left; } }\n.b { top: 0; }", "CSS", "Responsive Design", "Responsive styling", 0.8),
    ("import React from 'react';\nexport const A: React.FC<P> = x;", "TypeScript", "UI Component", "React Component", 0.85),
    ("interface P { a: any }\nuseState(1)", "TypeScript", "UI Component with Hooks", "React Hooks Component", 0.8),
    ("def f():\n    return open('a.json')", "JSON", "Data Structure", "Object", 0.75),
    ("#include <vector>\nx = 1", "C/C++", "Unknown", None, 0.82),
    ("def f(:\n    return (1", "Unknown", "Unknown", None, 0.75),
    ("def f():\n    return (1", "Python", "Unknown", None, 0.0),  # does not parse
])
def test_details_and_confidence(spark, text, language_, type_, detail, confidence):
    row = analyze(spark.createDataFrame([(text,)], "content string")).first()
    assert (row.language, row.type, row.specific_type, row.confidence) == (language_, type_, detail, confidence)


def test_report_rows_and_errors(spark):
    rows = spark.createDataFrame(
        [(1, "a.py", "class A:\n    def f(self):\n        if self:\n            return 1\n"), (2, "b", "  \n"), (3, "c", None)],
        "doc_id long, filename string, content string")
    got = {r.doc_id: r for r in report(rows).collect()}
    assert got[2].error == "Empty file" and got[3].error == "No code provided" and got[2].analysis is None
    ast_part = got[1].analysis.ast_analysis
    assert tuple(ast_part.structure) == (1, 1, 0) and ast_part.complexity.cyclomatic_complexity == 2
    assert got[1].error is None and got[1].language == "Python"


def test_models_fill_open_rows_only(spark):
    rows = spark.createDataFrame(
        [("plain words only here", "Go", "API", 0.9), ("def f():\n    pass", "Go", "API", 0.9)],
        "content string, ml string, mp string, mc double")
    got = analyze(rows, model_language="ml", model_purpose="mp", model_confidence="mc").collect()
    assert {(r.language, r.type, r.confidence) for r in got} == {("Go", "API", 0.9), ("Python", "API", 0.9)}
