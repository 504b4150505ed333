"""The extraction patterns and word lists that define the results.

``RE2`` holds each pattern in the dialect its semantics are defined in; the SQL
checks run these texts. The constants below it are the same patterns for the JVM:

* ``(?md)`` instead of ``(?m)``, so that only ``\\n`` ends a line;
* ``\\s`` spelled out, because the JVM adds the vertical tab;
* no ``\\b``, which is Unicode-aware on the JVM;
* possessive quantifiers wherever backtracking cannot change a match, so a long
  line costs linear time and constant stack.
"""

from __future__ import annotations

# Patterns in their defining dialect.
RE2 = {
    "js_import": r"""(?m)^import\s+.*?from\s+['"]([^'"]+)['"]""",
    "js_require": r"""(?m)require\(['"]([^'"]+)['"]\)""",
    "js_dynamic_import": r"""import\(['"]([^'"]+)['"]\)""",
    "js_export_named": r"(?m)^export\s+(?:const|let|var|function|class|async\s+function)\s+(\w+)",
    "js_export_default": r"(?m)^export\s+default\s+(?:function|class)?\s*(\w*)",
    "js_module_exports": r"(?m)module\.exports\s*=",
    "js_function": r"(?m)^(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)",
    "js_arrow": r"(?m)^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>",
    "js_class": r"(?m)^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)",
    "js_interface": r"(?m)^(?:export\s+)?interface\s+(\w+)",
    "js_type": r"(?m)^(?:export\s+)?type\s+(\w+)",
    "js_route": r"""(?m)(?:app|router)\.(get|post|put|delete|patch|head|options)\s*\(\s*['"]([^'"]+)['"]""",
    "py_import": r"(?m)^import\s+(\S+)",
    "py_from_import": r"(?m)^from\s+(\S+)\s+import",
    "py_function": r"(?m)^(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)",
    "py_class": r"(?m)^class\s+(\w+)(?:\(([^)]*)\))?:",
    "py_route": r"""(?m)^@\w+\.(get|post|put|delete|patch|route)\s*\(\s*['"]([^'"]+)['"]""",
    "py_all": r"(?m)^__all__\s*=\s*\[([^\]]+)\]",
    "dart_import": r"""(?m)^import\s+['"]([^'"]+)['"]""",
    "dart_export": r"""(?m)^export\s+['"]([^'"]+)['"]""",
    "dart_function": r"(?m)^(?:\w+\s+)*(\w+)\s*\([^)]*\)\s*(?:async\s*)?[{=]",
    "dart_class": r"(?m)^(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+(?:with|implements)\s+[^{]+)?",
    "dart_enum": r"(?m)^enum\s+(\w+)",
    "dart_mixin": r"(?m)^mixin\s+(\w+)",
    "dart_route": r"""(?m)['"](/[^'"]*)['"]\s*:\s*(?:\(.*?\)\s*=>)?\s*(\w+)""",
}

# Names a Dart function line may not declare.
DART_KEYWORDS = ("if", "for", "while", "switch", "catch", "class", "return")

# Go selector calls that declare a route, upper-cased.
GO_ROUTE_METHODS = (
    "GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "HANDLE", "HANDLEFUNC",
)

# File extension -> language.
LANGUAGE_BY_EXTENSION = {
    ".go": "Go",
    ".js": "JavaScript",
    ".jsx": "JavaScript",
    ".mjs": "JavaScript",
    ".cjs": "JavaScript",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".py": "Python",
    ".dart": "Dart",
}

# What a relative import may leave off, in order of preference.
IMPORT_SUFFIXES = (
    "", ".go", ".js", ".ts", ".jsx", ".tsx", ".py", ".dart", "/index.js", "/index.ts",
)

# Path endings of the report's entry points ("cmd/" counts anywhere).
REPORT_ENTRY_ENDINGS = (
    "main.go", "main.py", "index.js", "index.ts",
    "app.go", "app.js", "app.ts", "app.py",
    "server.go", "server.js", "server.ts", "server.py",
)
REPORT_ENTRY_FRAGMENT = "cmd/"

# Path fragments of the prompt's entry points.
PROMPT_ENTRY_FRAGMENTS = (
    "main.go", "main.py", "index.js", "index.ts", "app.go",
    "app.js", "app.ts", "server.go", "server.js", "server.ts",
    "cmd/", "src/main",
)

# White space as Unicode defines it, which trimming removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

S = r"[\t\n\f\r ]"  # white space
L = r"[\t\f\r ]"  # white space inside a line
NS = r"[^\t\n\f\r ]"

JS_IMPORT = rf"""(?md)^import{S}++.*?from{S}++['"]([^'"]++)['"]"""
JS_REQUIRE = r"""require\(['"]([^'"]++)['"]\)"""
JS_DYNAMIC_IMPORT = r"""import\(['"]([^'"]++)['"]\)"""
JS_EXPORT_NAMED = rf"(?md)^export{S}++(?:const|let|var|function|class|async{S}++function){S}++(\w++)"
JS_EXPORT_DEFAULT = rf"(?md)^export{S}++default{S}++(?:function|class)?+{S}*+(\w*+)"
JS_MODULE_EXPORTS = rf"module\.exports{S}*+="
JS_EXPORT_TAIL = rf"(?md)^export{S}++(.*+)"
JS_FUNCTION = rf"(?md)^(?:export{S}++)?(?:async{S}++)?function{S}++(\w++){S}*+\([^)]*+\)"
JS_ARROW = (
    rf"(?md)^(?:export{S}++)?(?:const|let|var){S}++(\w++){S}*+={S}*+(?:async{S}++)?\([^)]*+\){S}*+=>"
)
JS_CLASS = rf"(?md)^(?:export{S}++)?(?:abstract{S}++)?class{S}++(\w++)"
JS_INTERFACE = rf"(?md)^(?:export{S}++)?interface{S}++(\w++)"
JS_TYPE = rf"(?md)^(?:export{S}++)?type{S}++(\w++)"
JS_ROUTE = (
    rf"(?:app|router)\.(get|post|put|delete|patch|head|options){S}*+\({S}*+"
    r"""['"]([^'"]++)['"]"""
)

PY_IMPORT = rf"(?md)^import{S}++({NS}++)"
PY_FROM_IMPORT = rf"(?md)^from{S}++({NS}++){S}++import"
PY_FUNCTION = rf"(?md)^(?:async{L}++)?def{L}++(\w++){L}*+\([^)\n]*+\)"
# A route decorator counts only with the function on the very next line, so
# both lines are one pattern and no state has to be carried from line to line.
PY_ROUTE = (
    rf"(?md)^@\w++\.(get|post|put|delete|patch|route){L}*+\({L}*+"
    r"""['"]([^'"\n]++)['"][^\n]*+\n"""
    rf"(?:async{L}++)?def{L}++(\w++){L}*+\([^)\n]*+\)"
)
PY_CLASS = rf"(?md)^class{S}++(\w++)(?:\([^)]*+\))?+:"
PY_ALL = rf"(?md)^__all__{S}*+={S}*+\[([^\]]++)\]"

DART_IMPORT = rf"""(?md)^import{S}++['"]([^'"]++)['"]"""
DART_EXPORT = rf"""(?md)^export{S}++['"]([^'"]++)['"]"""
DART_FUNCTION = (
    rf"(?md)^(?:\w[\w\t\f\r ]*{L})?(\w++){L}*+\([^)\n]*+\){L}*+(?:async{L}*+)?[{{=]"
)
DART_CLASS = (
    rf"(?md)^(?:abstract{S}++)?class{S}++(\w++)(?:{S}++extends{S}++\w++)?"
    rf"(?:{S}++(?:with|implements){S}++[^{{]++)?"
)
DART_ENUM = rf"(?md)^enum{S}++(\w++)"
DART_MIXIN = rf"(?md)^mixin{S}++(\w++)"
DART_ROUTE = rf"""(?d)['"](/[^'"]*+)['"]{S}*+:{S}*+(?:\(.*?\){S}*+=>)?{S}*+(\w++)"""
