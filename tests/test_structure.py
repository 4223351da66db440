"""Structure tables against CPython's parser on texts inside the supported subset."""

import ast

from checks.corpus import TEMPLATES
from corpuscope.operators import structure

TEXTS = [t[4].replace("@@", "words, if any: x = 1") for t in TEMPLATES if t[0].endswith(".py") and len(t[4]) > 10]
TEXTS += [
    "import a.b as c, d\nfrom x import (y as z,\n  w)\nfrom .. import up\nv = w = 1\nu, t = 1, 2\nq: int = 3\nq += 1\nif v == 1:\n    pass\n",
    "def f(a, *args, b=1, **kw):\n    with a as b, c as d:\n        pass\n    s = '''\ndef not_code():\n'''\n    return s\n\n\n# tail\n",
    "class A:\n    def f(self): pass\n    class B:\n        def g(self, x=(1, [2, 3])):\n            while x:\n                break\n    def h(self):\n        return {\n            'k': 1,\n        }\n\nx = 1\n",
    "async def a(x):\n    async for y in x:\n        pass\n    for z in x:\n        try:\n            pass\n        finally:\n            pass\n",
    "y = [i for i in (1, 2)\n     if i]\n\ndef long_one(\n    first,\n    second=None,\n):\n    return first\nz = 2\n",
    # several statements on a line, back-slashes, suites on the line of their header
    "import os; import sys\nimport a, \\\n    b\nfrom c \\\n    import d as e, f; x = 1; y = 2;\nfor i in z: w = 1\nif x: import g\nelif y: import h; v = u = 3\nelse: t = 4\n",
    "class A: x = 1; y = 2\nclass B:\n    def f(self, a={1: 2}): b = a; return b\n    def g(self): pass\n    z = 1\nwhile True: break\ntry: import q\nexcept E: r = 1\nfinally: s = 2\nwith o as p: k = 1\n",
    "if f(lambda x: x): a = 1\nif (lambda: 1)() or (b := 2): c = 3\nwhile lambda: 1: d = 4\nif e := 5: g: int = 6; h = 7\nk = lambda v: v; m = {1: 2, 3: 4}; n = m[1:2]\n",
    "def f(a: int = 1,\n      b: dict = {1: ';'},\n      ) -> int: c = a; d = 2; return c\n\ndef g(\n  x): return x\ne = 1\nif (e and\n    f): h = 1; k = 2\nz = 3\n",
    r"""a = '\'; b = 1' ; c = r'\'' ; d = "# ; e = 1" ; f = 2 # ; g = 3""" + "\nh = '''x\"\"\"; i = 1\n; j = 2'''; k = 3\nl = \"\"\"it's \\\"\"\"\"; m = 1\n'''\"\"\"'''; n = 4\n",
    "o = 'one \\\ntwo; p = 1'; q = 2\nr = 1 + \\\n    2; s = 3\nt \\\n  = 4\nu = v == w; x = y = z = 5\na.b = c = d[0] = e = 6\nf[1:2], g = h = 7\ni += 1; j: int = 2; k == l\n*m, n = p = q\n",
    "async def f(): import a; b = 1\nasync def g():\n    async with a: c = 1\n    with a: d = 2\nmatch x:\n    case 1: e = 3\n    case {'k': y}: z = 4\n    case _: pass\n",
    "def f(x):\n    y = x;\n    if x: return y; y = 2\n    return 1\n\n\nclass C:\n  def m(self): self.x = 1; z = 2\n  class D: import w\n  def n(self):\n    return '''\n; q = 1\n'''; r = 1\n# tail ; s = 1\n",
    "x = 1 if y else 2 ; z = 3\nif x: y = 1 # c: d = 2\nprint(a=1, b='c = d'); t = (1,\n 2); u = [\n 3]; v = 4\nassert x == y, 'a'; w = x != y; p = q = x <= y\n",
]


def _parsed(text):
    tree = ast.parse(text)
    functions, classes, imports, variables, control = [], [], [], [], 0
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef):
            functions.append((node.name, tuple(a.arg for a in node.args.args), node.lineno, node.end_lineno))
        elif isinstance(node, ast.ClassDef):
            methods = tuple(c.name for c in node.body if isinstance(c, ast.FunctionDef))
            classes.append((node.name, methods, node.lineno, node.end_lineno))
        elif isinstance(node, ast.Import):
            imports += [(a.name, a.asname, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [(f"{node.module}.{a.name}" if node.module else a.name, a.asname, node.lineno) for a in node.names]
        elif isinstance(node, ast.Assign):
            variables += [(t.id, node.lineno) for t in node.targets if isinstance(t, ast.Name)]
        control += isinstance(node, (ast.If, ast.For, ast.While, ast.Try, ast.With))
    lines = max(getattr(n, "end_lineno", 0) for n in ast.walk(tree))
    return functions, classes, imports, variables, control, lines


def test_tables_agree_with_the_parser(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, content string").cache()
    got = {i: ([], [], [], []) for i in range(len(TEXTS))}
    for r in structure.functions_table(df).collect():
        got[r.doc_id][0].append((r.name, tuple(r.args), r.start_line, r.end_line))
    for r in structure.classes_table(df).collect():
        got[r.doc_id][1].append((r.name, tuple(r.methods), r.start_line, r.end_line))
    for r in structure.imports_table(df).collect():
        got[r.doc_id][2].append((r.name, r.alias, r.line))
    for r in structure.variables_table(df).collect():
        got[r.doc_id][3].append((r.name, r.line))
    rows = {r.doc_id: r for r in structure.complexity_table(df).collect()}
    for i, text in enumerate(TEXTS):
        *tables, control, lines = _parsed(text)
        for mine, theirs in zip(got[i], tables):
            assert sorted(mine, key=str) == sorted(theirs, key=str), text
        assert rows[i].control_structures == control and rows[i].cyclomatic_complexity == control + 1, text
        assert rows[i].line_count == lines, text
        assert [rows[i].functions, rows[i].classes, rows[i].imports, rows[i].variables] == [len(t) for t in tables]
