"""A code corpus derived from the given documents.

The documents are prose, so each is set, whole, into one of the templates below (by key), at
the place marked ``@@``, behind the template's line prefix.  Every document gives one corpus
row, so work on the corpus grows with the documents.  The same templates feed both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.sql import md5_int, q
from corpuscope.functions import text as tx
from corpuscope.sources.shared import shared_folder

# (filename, language as declared by the collection, origin, line prefix, body)
TEMPLATES: list[tuple[str, str, str, str, str]] = [
    ("shelf.py", "Python", "github", "    ", '"""@@"""\nimport csv, sys\nfrom pathlib import Path\n\n\nclass Shelf:\n    width = 40\n\n    def label(self, row):\n        return row["title"][:self.width]\n\n    def lines(self, folder):\n        for path in Path(folder).glob("*.csv"):\n            with path.open() as source:\n                for row in csv.DictReader(source):\n                    yield self.label(row)\n\n\ndef main(argv):\n    if len(argv) > 1:\n        shelf = Shelf()\n        print(*shelf.lines(argv[1]))\n\n\nmain(sys.argv)\n'),
    ("loader.py", "Python", "github", "# ", 'import numpy as np\nimport pandas as pd\nfrom os.path import (\n    join,\n    basename as base,\n)\nfrom . import sibling\nfrom .pkg import thing as other\nfrom typing import *\n# @@\n\nclass Loader(Base):\n    """Loads\n    data."""\n    limit: int = 3\n    kind = mode = "plain"\n\n    def __init__(self, path, sep=",", *rest, strict=True):\n        self.path = path\n        first, second = path, sep\n\n    def rows(\n        self,\n        start: int = 0,\n        stop: dict[str, int] = dict(a=(1, 2)),\n    ) -> list:\n        table = pd.read_csv(self.path)\n        for row in table:\n            while row:\n                try:\n                    with open(row) as fh:\n                        value = fh.read()\n                except OSError:\n                    continue\n# low comment\n                else:\n                    row = None\n        return [r\n                for r in table\n                if r]\n\n    if True:\n        def hidden(self):\n            return None\n\n    async def later(self, x):\n        return x\n\n\n\n\ndef top(a, b, /, c, *, d):\n    def inner(x):\n        return x\n    total = other = a\n    if a == b:\n        return inner(c)\n    elif a:\n        return d\n    return total\nimport os; import sys as system\nfrom json \\\n    import dumps, loads as read\nif total: import re; flag = on = 1\nelse: low = {1: 2}; high = low[1:]\nfor part in top: words = part; count \\\n    = 2\nwhile flag: break\n'),
    ("squares.py", "Python", "github", "# ", 'def run():\n    squares = [x**2 for x in range(10)]\n    return squares\n\nprint(run())\n# @@\n'),
    ("palin.py", "Python", "github", "# ", "def is_palindrome(s):\n    return s == s[::-1]\n# @@\n"),
    ("primes.py", "Python", "stackoverflow", "# ", "def is_prime(n):\n    if n <= 1:\n        return False\n    for i in range(2, int(n**0.5) + 1):\n        if n % i == 0:\n            return False\n    return True\n# @@\n"),
    ("web.py", "Python", "github", "# ", "from flask import Flask, jsonify\napp = Flask(__name__)\n# @@\n@app.route('/api/size')\ndef size():\n    return jsonify({'size': 6})\n"),
    ("admin.py", "Python", "github", "# ", "import django\nimport requests\n# @@\nclass Site(object):\n    def name(self):\n        return 'x'\n    def url(self):\n        return 'y'\n    def a(self): pass\n    def b(self): pass\n    def c(self): pass\n    def d(self): pass\n"),
    ("chart.py", "Python", "github", "# ", "import matplotlib\n# @@\ndef plot(rows):\n    return rows\n"),
    ("stats.py", "Python", "github", "# ", "import pandas\n# @@\ndef data(frame):\n    return frame.merge(frame).groupby('k')\n"),
    ("crlf.py", "Python", "github", "# ", "import json\r\n\r\ndef née(é, ü=1):\r\n    '''one\r\n    two'''\r\n    naïve = é\r\n    return naïve\r\n# @@\r\n"),
    ("names.py", "Python", "github", "# ", 'def load():\n    return open("settings.json")\n# @@\n'),
    ("app.js", "JavaScript", "github", " * ", "/* @@ */\nfunction widest(rows) {\n    let most = 0;\n    for (const row of rows) { most = Math.max(most, row.length); }\n    return most;\n}\n"),
    ("sort.js", "JavaScript", "github", "// ", "// @@\nconst bubbleSort = (arr) => {\n  for (let i = 0; i < arr.length; i++) { swap(arr, i); }\n  return arr;\n};\n"),
    ("palin.js", "JavaScript", "stackoverflow", "// ", "function isPalindrome(str) {\n  return str === str.split('').reverse().join('');\n}\n// @@\n"),
    ("server.js", "JavaScript", "github", "// ", "const express = require('express');\nconst app = express();\n// @@\nfunction start(port) {\n  return app.listen(port);\n}\nconsole.log('node');\n"),
    ("Box.jsx", "JavaScript", "github", "  ", "<Box sx={{ padding: 2, color: 'red' }}>\n  @@\n</Box>\n"),
    ("styles.js", "JavaScript", "github", "// ", "const styles = {\n  card: { display: 'flex', padding: 4 },\n};\nexport default styles;\n// @@\n"),
    ("widget.js", "JavaScript", "github", "// ", "import React from 'react';\nfunction Widget() {\n  return (\n    <button onclick={press}>go</button>\n  );\n}\n// @@\n"),
    ("dom.js", "JavaScript", "stackoverflow", "// ", "document.title = heading;\nwindow.open(page);\nbutton.addEventListener(click);\n// @@\n"),
    ("mixed.js", "JavaScript", "github", "// ", "let theme = `body { margin: 4px; padding: 2px; }`;\nvar styles;\n// @@\n"),
    ("sheet-in-js.js", "JavaScript", "github", "// ", "return css`.card { margin: 4px; } body { padding: 2px; }`\n// @@\n"),
    ("box.ts", "TypeScript", "github", "// ", "// @@\ninterface Box {\n  width: number;\n  label: string;\n}\nexport type Size = 'a' | 'b';\n"),
    ("Card.tsx", "TypeScript", "github", "// ", "import React from 'react';\ninterface CardProps { title: string }\nexport const Card: React.FC<CardProps> = ({ title }) => <b>{title}</b>;\n// @@\n"),
    ("Hook.tsx", "TypeScript", "github", "// ", "import React, { useState } from 'react';\nexport function useFlag(start: boolean) {\n  return useState(start);\n}\n// @@\n"),
    ("index.html", "HTML", "github", "", "<!DOCTYPE html>\n<html>\n<head><title>t</title></head>\n<body><div class=\"main\"><p>@@</p></div></body>\n</html>\n"),
    ("part.html", "HTML", "stackoverflow", "", "<DIV CLASS='x'><h2>@@</h2></DIV>\n"),
    ("site.css", "CSS", "github", " * ", "/* @@ */\nbody {\n  margin: 0;\n  color: #333;\n}\n.page-container {\n  padding: 10px;\n  display: flex;\n}\n"),
    ("box.css", "CSS", "github", " * ", "/* @@ */\n.box-container {\n  margin: 4px;\n  border-radius: 4px;\n}\n"),
    ("wide.css", "CSS", "github", " * ", "/* @@ */\n@media screen and (max-width: 600px) {\n  .row { padding: 4px; }\n}\n"),
    ("float.css", "CSS", "stackoverflow", " * ", "/* @@ */\ndiv { float: left; clear: both; }\n"),
    ("loose.css", "CSS", "stackoverflow", "", "use color: red and position: fixed here @@\n"),
    ("empty-rule.css", "CSS", "stackoverflow", "", "html { inherit } @@\n"),
    ("data.json", "JSON", "github", " ", "{\n  \"name\": \"demo\",\n  \"size\": [1, 2],\n  \"text\": \"@@\"\n}\n"),
    ("list.json", "JSON", "github", " ", "[\n  {\"id\": 1, \"note\": \"@@\"},\n  {\"id\": 2}\n]\n"),
    ("deploy.yml", "YAML", "github", "# ", "name: demo\nversion: two\nsteps:\n  - run: build\n# @@\n"),
    ("dash.yaml", "YAML", "github", "# ", "---\nkind: list\nsize: 3\n# @@\n"),
    ("prod.env", "Configuration", "github", "# ", "DB_HOST=\"localhost\"\nDB_PORT=\"5432\"\nDEBUG=1\n# @@\n"),
    ("requirements.txt", "Configuration", "github", "# ", "# requirements.txt file\nrequests==2.1\nflask>=1.0\n# @@\n"),
    ("core.ini", "Configuration", "github", "; ", "# local.env sample\n[core]\nname = demo\n; @@\n"),
    ("quoted.cfg", "Configuration", "stackoverflow", "# ", "load '/etc/.env' first\n# @@\n"),
    ("quoted.txt", "JSON", "stackoverflow", "# ", "read \"conf/app-.json\" next\n# @@\n"),
    ("link.txt", "CSS", "stackoverflow", "", "the theme lives in main.css\nand @@\n"),
    ("ends.txt", "YAML", "stackoverflow", "", "see conf/ci.yml\n@@\n"),
    ("main.cpp", "C/C++", "github", "// ", "#include <iostream>\nusing namespace std;\nint main() {\n    std::cout << \"hi\" << std::endl;\n    return 0;\n}\n// @@\n"),
    ("short.cpp", "C/C++", "stackoverflow", "// ", "cout << total;\n// @@\n"),
    ("Area.java", "Java", "github", " * ", "/* @@ */\npublic class Area {\n    private int w;\n    public int of(int h) { return w * h; }\n}\n"),
    ("query.sql", "SQL", "github", "-- ", "-- @@\nSELECT name, count(*) FROM boxes GROUP BY name;\nINSERT INTO boxes VALUES (1);\n"),
    ("run.sh", "Shell/Bash", "github", "# ", "#!/bin/sh\n# @@\nls | wc -l\n"),
    ("main.go", "Go", "github", "// ", "package main\n\nfunc area(w, h int) int {\n\treturn w * h\n}\n// @@\n"),
    ("notes.rb", "Ruby", "github/data_processing", "# ", "# @@\nnames.each do |n|\n  puts n\nend\n"),
    ("view.php", "PHP", "github/web_ui", "// ", "<?php\n// @@\necho $area;\n?>\n"),
    ("Size.cs", "C#", "github/utility", "// ", "using System;\n// @@\nclass Size { static void Main() { Console.WriteLine(6); } }\n"),
    ("lib.rs", "Rust", "github/api", "// ", "// @@\nfn area(w: u32, h: u32) -> u32 { w * h }\n"),
    ("long.py", "Python", "github", "    ", 'def steps(n):\n    """@@"""\n' + "".join(f"    step_{i} = n + {i}\n" for i in range(36)) + "    return n\n"),
    ("test_area.js", "JavaScript", "github", "// ", "// @@\ntest('area', () => {\n  expect(area(2, 3)).toBe(6);\n});\n"),
    ("plain.md", "Markdown", "stackoverflow", "", "@@"),
    ("tiny.py", "Python", "stackoverflow", "", "x=1"),
    ("blank.txt", "Markdown", "stackoverflow", "", " \n\t \n"),
    ("gap.js", "JavaScript", "github", " * ", "var a = 1;\n\n\n\n\n/* @@ */\n\n\n\nlet b = a;\nb.call(a);\n"),
    ("sets.py", "Python", "stackoverflow", "# ", "def merge_sort(rows):\n    # @@\n    if len(rows) < 2: return rows\n    mid = len(rows) // 2\n    left, right = rows[:mid], rows[mid:]\n    return left + right\n\nprint(merge_sort([3, 1]))  # merge sort\n"),
]
T = len(TEMPLATES)


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        _placed(), "template_id long, extra boolean, filename string, language string, origin string, prefix string, body string")


def _placed() -> list[tuple]:
    """Templates by number.  One without a place for the text is an extra row beside the whole text."""
    plain = next(t for t in TEMPLATES if t[4] == "@@")
    rows = []
    for i, t in enumerate(TEMPLATES):
        without = "@@" not in t[4]
        rows += [(i, False, *(plain if without else t))] + [(i, True, *t)] * without
    return rows


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark) -> str:
    """A new folder in the place the cluster shares."""
    return shared_folder(spark, "checks")


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, filename, language, origin, source, content, stars, votes; one row per document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("_src"))
    placed = F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), F.col("prefix")))
    number = tx.md5_int(F.col("doc_id").cast("string"))
    return (
        docs.join(F.broadcast(template_table(spark)), F.col("doc_id") % T == F.col("template_id"))
        .select(
            F.when(F.col("extra"), -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), "filename", "language", "origin",
            F.concat("origin", F.lit(":"), "_src", F.lit("/"), "filename").alias("source"),
            F.replace(F.col("body"), F.lit("@@"), placed).alias("content"),
            (number % 1000).alias("stars"),
            F.when(number % 7 == 0, F.lit("n/a")).otherwise((number % 9).cast("string")).alias("votes"),
        )
    )


def corpus_sql(name: str = "corpus") -> str:
    """``name AS (...)``: the same corpus for SQL."""
    rows = ",\n".join(f"({i}, {extra}, {', '.join(q(v) for v in t)})" for i, extra, *t in _placed())
    number = md5_int("doc_id::VARCHAR")
    return f"""templates(template_id, extra, filename, language, origin, prefix, body) AS (VALUES
{rows}),
{name} AS (
  SELECT CASE WHEN t.extra THEN -1 - d.doc_id ELSE d.doc_id END AS doc_id, t.filename, t.language, t.origin,
         t.origin || ':' || d.source || '/' || t.filename AS source,
         replace(t.body, '@@', replace(d.text, chr(10), chr(10) || t.prefix)) AS content,
         {number} % 1000 AS stars,
         CASE WHEN {number} % 7 = 0 THEN 'n/a' ELSE ({number} % 9)::VARCHAR END AS votes
  FROM documents d JOIN templates t ON d.doc_id % {T} = t.template_id)"""
