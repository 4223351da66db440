"""Pattern, keyword and lookup tables that decide the results."""

from __future__ import annotations

# --- Fixed values: language pattern catalogue, matched without regard to case ------------
LANGUAGE_PATTERNS = {
    "Python": [
        r"def\s+\w+\s*\(.*\):",
        r"import\s+\w+",
        r"from\s+\w+\s+import",
        r"class\s+\w+\s*(\(.*\))?:",
    ],
    "JavaScript": [
        r"function\s+\w+\s*\(",
        r"const\s+\w+\s*=",
        r"let\s+\w+\s*=",
        r"var\s+\w+\s*=",
        r"console\.log",
    ],
    "TypeScript": [
        r"interface\s+\w+\s*{",
        r"type\s+\w+\s*=",
        r"class\s+\w+\s*(?:implements|extends)?",
        r":\s*(?:string|number|boolean|any|void)\b",
        r"import\s+[^;]+\s+from\s+[\'\"]",
        r"export\s+(?:default\s+)?(?:const|function|class|interface|type)",
        r"React\.FC<.*>",
        r"<.*Props>",
        r"tsx?$",
    ],
    "HTML": [
        r"<!DOCTYPE\s+html>",
        r"<html",
        r"<head",
        r"<body",
        r"<div\s+class=",
    ],
    "CSS": [
        r"body\s*{[^}]*}",
        r"\.\w+\s*{[^}]*}",
        r"#\w+\s*{[^}]*}",
        r"@media\s+[^{]*{",
        r"@keyframes\s+\w+\s*{",
        r"@import\s+url\([\'\"]?[^\'\"]+[\'\"]?\);",
        r"@font-face\s*{",
        r"color\s*:\s*(?:#[0-9a-fA-F]{3,6}|rgb)",
        r"margin\s*:\s*\d+(?:px|%|rem|em)",
        r"padding\s*:\s*\d+(?:px|%|rem|em)",
        r"display\s*:\s*(?:flex|block|grid|inline)",
        r"background(?:-color)?\s*:\s*(?:#[0-9a-fA-F]{3,6}|rgba?\()",
        r"font-size\s*:\s*\d+(?:px|%|rem|em)",
        r"flex\s*:\s*(?:\d+|\d+\s+\d+\s+\d+)",
        r"gap\s*:\s*\d+(?:px|%|rem|em)",
        r"border(?:-radius)?\s*:\s*",
        r"css$",
    ],
    "JSON": [
        r"^\s*\{",
        r'\s*"\w+"\s*:',
        r'\[\s*\{\s*"',
        r"json$",
    ],
    "YAML": [
        r"^\s*---\s*$",
        r"^\s*\w+\s*:\s*\w+\s*$",
        r"^\s*-\s+\w+\s*:\s*",
        r"yml$|yaml$",
    ],
    "Configuration": [
        r"^\s*\w+\s*=\s*[\'\"]\w+[\'\"]\s*$",
        r"^\s*#\s*\w+\s*configuration",
        r"^\s*export\s+\w+\s*=",
        r"config\.\w+|configuration|\.env$|\.ini$|\.cfg$|requirements\.txt$",
        r"(?:^|\n)\s*\[\w+\]\s*(?:$|\n)",
    ],
    "C/C++": [
        r"#include\s*<",
        r"int\s+main\s*\(",
        r"std::\w+",
        r"using\s+namespace\s+std",
    ],
}

# Weights of the weighted scorer, 1.0 where not listed.
LANGUAGE_WEIGHTS = {
    "CSS": 1.5, "TypeScript": 1.2, "JavaScript": 1.3, "Configuration": 1.8,
    "JSON": 1.6, "YAML": 1.6, "HTML": 1.5, "Python": 1.4,
}

# --- Fixed values: presence lists of the rule cascade, matched without regard to case -----
CSS_SELECTORS = [
    r"body\s*{",
    r"\.\w+(-\w+)*\s*{",
    r"#\w+\s*{",
    r"@media\s+",
    r"@keyframes\s+",
    r"@import\s+url\(",
    r"display\s*:\s*(?:block|flex|grid|inline)",
    r"margin\s*:\s*\d+(?:px|rem|em|%)",
    r"padding\s*:\s*\d+(?:px|rem|em|%)",
    r"color\s*:\s*(?:#[0-9a-fA-F]{3,6}|rgb|rgba)",
    r"font-size\s*:",
]
SCRIPT_HINTS = [
    r"function\s+\w+",
    r"var\s+\w+",
    r"let\s+\w+",
    r"const\s+\w+",
    r"import\s+",
    r"export\s+",
    r"console\.",
    r"=>\s*{",
    r"}\s*else\s*{",
    r"if\s*\(",
    r"return\s+",
]
SCRIPT_EVIDENCE = [
    r"function\s+\w+\s*\([^:]*\)",
    r"var\s+\w+\s*=",
    r"let\s+\w+\s*=",
    r"const\s+\w+\s*=",
    r"console\.log",
    r"document\.",
    r"window\.",
    r"addEventListener",
    r"setTimeout",
    r"for\s*\(\s*(?:var|let|const)?\s*\w+",
    r"if\s*\([^:]*\)\s*\{",
    r"return\s+\w+(?:\s*\+\s*\w+)+;",
    r"\w+\.\w+\(.*\);",
    r"\(\s*\)\s*=>\s*\{",
    r"import\s+[\w{},\s]+\s+from",
    r"export\s+(?:default\s+)?(?:function|const|class)",
    r"sx\s*=\s*\{\s*\{",
    r"style\s*=\s*\{\s*\{",
    r"className\s*=",
]
CSS_PROPERTIES = [
    r"color\s*:",
    r"background\s*:",
    r"margin\s*:",
    r"padding\s*:",
    r"font-size\s*:",
    r"display\s*:",
    r"position\s*:",
    r"width\s*:",
    r"height\s*:",
]
CPP_MARKERS = [
    r"#include\s+<(?:iostream|vector|string|algorithm|cmath|stdio\.h|stdlib\.h)>",
    r"int\s+main\s*\(\s*(?:void|int\s+argc,\s*char\s*\*\s*argv\[\]|)\s*\)\s*{",
    r"std::\w+",
    r"cout\s*<<",
    r"cin\s*>>",
    r"template\s*<\s*(?:class|typename)",
]

# --- Fixed values: editor-side language guess, ECMAScript meaning (ASCII \w) ---------------
# The css patterns are matched without regard to case, the others with it.
EDITOR_PATTERNS = {
    "css": [
        r"body\s*{[^}]*}",
        r"\.\w+\s*{[^}]*}",
        r"#\w+\s*{[^}]*}",
        r"@media",
        r"@import\s+url",
        r"@keyframes",
        r"@font-face",
        r"margin\s*:",
        r"padding\s*:",
        r"color\s*:",
        r"background\s*:",
        r"display\s*:\s*(?:flex|block|grid|inline)",
    ],
    "python": [
        r"def\s+\w+\s*\(.*\):",
        r"import\s+\w+",
        r"from\s+\w+\s+import",
        r"class\s+\w+\s*(\(.*\))?:",
    ],
    "javascript": [
        r"function\s+\w+\s*\(",
        r"const\s+\w+\s*=",
        r"let\s+\w+\s*=",
        r"var\s+\w+\s*=",
        r"console\.log",
    ],
    "typescript": [
        r"interface\s+\w+\s*{",
        r"type\s+\w+\s*=",
        r"class\s+\w+\s*(?:implements|extends)?",
        r":\s*(?:string|number|boolean|any|void)\b",
        r"import\s+[^;]+\s+from\s+['\"]",
        r"export\s+(?:default\s+)?(?:const|function|class|interface|type)",
    ],
    "html": [
        r"<!DOCTYPE\s+html>",
        r"<html",
        r"<head",
        r"<body",
        r"<div\s+class=",
    ],
}
EDITOR_EXTENSIONS = {"css": "css", "html": "html", "py": "python", "ts": "typescript", "js": "javascript"}
EDITOR_FILENAME_EXTENSIONS = {**EDITOR_EXTENSIONS, "tsx": "typescript"}

# --- Fixed values: file extensions of a language -------------------------------------------
LANGUAGE_EXTENSIONS = {
    "Python": ["py"],
    "JavaScript": ["js"],
    "TypeScript": ["ts", "tsx"],
    "HTML": ["html", "htm"],
    "CSS": ["css"],
    "Java": ["java"],
    "C/C++": ["c", "cpp", "h", "hpp"],
    "Ruby": ["rb"],
    "Go": ["go"],
    "PHP": ["php"],
    "Shell/Bash": ["sh", "bash"],
    "JSON": ["json"],
    "YAML": ["yml", "yaml"],
    "Configuration": ["env", "ini", "cfg", "conf", "config"],
    "Rust": ["rs"],
    "SQL": ["sql"],
    "C#": ["cs"],
}
DISPLAY_LANGUAGES = [
    "Python", "JavaScript", "TypeScript", "HTML", "CSS",
    "Java", "C/C++", "C#", "Ruby", "Go", "Rust", "PHP",
    "JSON", "YAML", "Shell/Bash", "SQL", "Markdown", "XML",
]

# --- Fixed values: keyword groups of the purpose labeller, first group that hits wins -------
# They are looked for in lower-cased text, so entries with capitals never hit; they are kept
# because they are part of the table.
PURPOSE_KEYWORDS = {
    "Algorithm Implementation": [
        "factorial", "fibonacci", "sort", "search", "palindrome",
        "prime", "binary", "algorithm", "recursive", "recursion",
        "bubble sort", "quick sort", "merge sort", "binary search",
        "depth first", "breadth first", "dijkstra", "dynamic programming",
        "backtracking", "memoization", "divide and conquer",
    ],
    "UI Component": [
        "<div", "<button", "<input", "react.component", "render()",
        "return (", "jsx", "className=", "style=", "onclick=",
        "vue.component", "angular.component", "svelte.component",
        "template", "props", "state", "useState", "useEffect",
        "componentDidMount", "componentWillUnmount", "render()",
        "return <", "export default function", "const Component",
    ],
    "Styling": [
        "color:", "font-size:", "margin:", "padding:", "background:",
        "display:", "flex:", "grid:", "border:", "width:", "height:",
        "@media", "@keyframes", "@import", "animation:", "transition:",
        "transform:", "box-shadow:", "border-radius:", "position:",
        "z-index:", "opacity:", "visibility:", "cursor:", "text-align:",
    ],
    "API": [
        "fetch(", "axios.get", "http.get", "api/", "endpoint",
        "route(", "@app.route", "res.json", "return json",
        "express.Router", "app.get", "app.post", "app.put", "app.delete",
        "restController", "@RestController", "@RequestMapping",
        "graphql", "apollo", "resolver", "mutation", "query",
        "grpc", "protobuf", "service", "rpc",
    ],
    "Data Processing": [
        "process_data", "transform", "filter", "map", "reduce",
        "groupby", "aggregate", "pandas", "numpy", "dataframe",
        "spark", "pyspark", "rdd", "dataset", "dataframe",
        "etl", "extract", "transform", "load", "data pipeline",
        "data cleaning", "data validation", "data normalization",
        "data aggregation", "data analysis", "data visualization",
    ],
    "Utility": [
        "utils.", "helper", "utility", "format", "parse",
        "convert", "validate", "check", "is_", "has_",
        "sanitize", "normalize", "encode", "decode",
        "encrypt", "decrypt", "hash", "verify",
        "logger", "logging", "error handling", "exception",
        "config", "configuration", "settings", "options",
    ],
    "Database": [
        "sql", "select", "insert", "update", "delete",
        "create table", "alter table", "drop table",
        "mongodb", "mongoose", "collection", "document",
        "redis", "key-value", "cache", "session",
        "orm", "sequelize", "typeorm", "prisma",
        "migration", "schema", "model", "entity",
    ],
    "Testing": [
        "test(", "describe(", "it(", "expect(", "assert(",
        "jest", "mocha", "chai", "cypress", "selenium",
        "unit test", "integration test", "e2e test",
        "mock", "stub", "spy", "fixture", "setup",
        "teardown", "beforeEach", "afterEach",
    ],
}
STYLING_LANGUAGES = ["css", "scss", "less", "sass", "stylus"]

# Purpose told by a fragment of the source string, in order.
SOURCE_PURPOSES = [
    ("web_ui", "Web UI"), ("data_processing", "Data Processing"), ("api", "API"), ("utility", "Utility"),
]

# Accepted alternatives of an expected purpose.
ACCEPTED_PURPOSES = {
    "UI Component": ["Frontend", "Web Component", "React Component"],
    "Styling": ["CSS", "UI Styling", "Style Definition"],
}

# --- Fixed values: emoji ---------------------------------------------------------------------
SUMMARY_EMOJI = {
    "Python": "🐍", "JavaScript": "📜", "TypeScript": "🔷", "HTML": "📱", "CSS": "🎨",
    "Java": "☕", "Ruby": "💎", "PHP": "🐘", "Go": "🐹", "Rust": "🦀", "C/C++": "⚙️",
    "Shell/Bash": "💻", "JSON": "📊", "YAML": "📝", "Configuration": "⚙️", "SQL": "🗄️", "C#": "🔶",
}
SUMMARY_EMOJI_DEFAULT = "📄"
MODEL_SUMMARY_EMOJI = {
    "JavaScript": "🌐", "TypeScript": "🌐", "HTML": "🌐", "CSS": "🌐", "Python": "🐍", "Java": "☕",
    "C/C++": "⚙️", "Configuration": "⚙️", "YAML": "⚙️", "Shell/Bash": "🐚", "JSON": "📊",
}
MODEL_SUMMARY_EMOJI_ML = "🤖"
MODEL_SUMMARY_EMOJI_DEFAULT = "🧾"

# Libraries named in a summary.
KNOWN_LIBRARIES = ["pandas", "numpy", "tensorflow", "torch", "flask", "django", "requests", "matplotlib"]

# --- Our own example snippets: used where no collected data exists --------------------------
LANGUAGE_SEEDS = {
    "Python": ["def area(w, h):\n    return w * h\n\nprint(area(2, 3))", "import os\nfor name in os.listdir('.'):\n    print(name)"],
    "JavaScript": ["function area(w, h) {\n  return w * h;\n}\nconsole.log(area(2, 3));", "const names = ['a', 'b'];\nnames.forEach(n => console.log(n));"],
    "TypeScript": ["interface Box {\n  width: number;\n  label: string;\n}", "function size(box: Box): number {\n  return box.width;\n}"],
    "HTML": ["<!DOCTYPE html>\n<html>\n<body><p>Area</p></body>\n</html>", "<div class=\"row\"><span>Area</span></div>"],
    "CSS": [".row {\n  display: flex;\n  margin: 4px;\n}", "body {\n  color: #222;\n}"],
    "Java": ["public class Area {\n    public static int of(int w, int h) { return w * h; }\n}", "import java.util.List;\nclass Names { List<String> all; }"],
    "C/C++": ["#include <stdio.h>\nint main(void) { printf(\"6\\n\"); return 0; }", "#include <vector>\nstd::vector<int> sizes;"],
    "PHP": ["<?php\n$area = $w * $h;\necho $area;\n?>", "<?php foreach ($names as $n) { echo $n; } ?>"],
    "Go": ["package main\n\nfunc area(w, h int) int {\n\treturn w * h\n}", "package main\nimport \"os\"\nfunc main() { os.Exit(0) }"],
    "Ruby": ["def area(w, h)\n  w * h\nend\nputs area(2, 3)", "names.each do |n|\n  puts n\nend"],
    "Shell/Bash": ["#!/bin/sh\nfor f in *; do echo \"$f\"; done", "#!/bin/bash\nset -e\nls | wc -l"],
    "SQL": ["SELECT name, count(*) FROM boxes GROUP BY name;", "CREATE TABLE boxes (name TEXT, width INT);"],
    "C#": ["using System;\nclass Area { static void Main() { Console.WriteLine(6); } }", "namespace Boxes { public class Box { public int Width { get; set; } } }"],
    "Rust": ["fn area(w: u32, h: u32) -> u32 {\n    w * h\n}", "struct Box2 { width: u32 }\nimpl Box2 { fn size(&self) -> u32 { self.width } }"],
}
PURPOSE_SEEDS = {
    "Algorithm Implementation": ["def gcd(a, b):\n    while b:\n        a, b = b, a % b\n    return a", "function insertionSort(xs) {\n  for (let i = 1; i < xs.length; i++) { place(xs, i); }\n  return xs;\n}"],
    "Machine Learning": ["from sklearn.linear_model import Ridge\nmodel = Ridge().fit(X, y)\nprint(model.score(X, y))"],
    "Web Development": ["from flask import Flask\napp = Flask(__name__)\n@app.route('/size')\ndef size():\n    return '6'"],
    "Database Operations": ["import sqlite3\ncon = sqlite3.connect('boxes.db')\ncon.execute('INSERT INTO boxes VALUES (1)')"],
    "Utility Function": ["def shorten(text, n):\n    return text[:n]", "function pad(s) {\n  return s.padStart(8);\n}"],
    "Math Computation": ["cubes = [x**3 for x in range(9)]\nprint(cubes)"],
}
# One example per purpose, added when a training set has fewer than two classes.
MISSING_CLASS_SEEDS = {
    "Algorithm Implementation": "def power(b, e):\n    return 1 if e == 0 else b * power(b, e - 1)",
    "UI Component": "function Label() {\n    return (<button onClick={press}>Press</button>);\n}",
    "Styling": ".note {\n    color: blue;\n    font-size: 11px;\n}",
    "API": "async function boxes() {\n    const r = await fetch('/api/boxes');\n    return r.json();\n}",
    "Data Processing": "def process_data(df):\n    return df.groupby('kind').sum()",
    "Utility": "function formatName(name) {\n    return name.trim();\n}",
    "Database": "SELECT name FROM boxes WHERE width > ?",
    "Testing": "test('area', () => {\n    expect(area(2, 3)).toBe(6);\n});",
}
