"""A source corpus derived from the given tables, for checks and benches.

Each order and each document becomes one file by a plain projection, so the
corpus grows with the tables and needs no shuffle. A third of all files belong
to one project (``mono``), so per-project work is skewed on purpose. The same
expression text runs in Spark SQL and in DuckDB SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_CHARS = {"'": 39, "\n": 10, "\t": 9, "\r": 13, "\x0b": 11, "\x0c": 12, "\\": 92}


def _text(template: str) -> str:
    """SQL for a template whose ``[[expr]]`` parts are SQL expressions."""
    parts = []
    for i, piece in enumerate(re.split(r"\[\[(.*?)\]\]", template)):
        if i % 2:
            parts.append(f"CAST({piece} AS {{string}})")
            continue
        for token in re.findall(r"['\n\t\r\x0b\x0c\\]|[^'\n\t\r\x0b\x0c\\]+", piece):
            parts.append(f"chr({_CHARS[token]})" if token in _CHARS else f"'{token}'")
    return f"concat({', '.join(parts)})" if parts else "''"


def _lines(lines: list[tuple[str | None, str]]) -> str:
    cells = [_text(t) if cond is None else f"CASE WHEN {cond} THEN {_text(t)} END" for cond, t in lines]
    return "concat_ws(chr(10), " + ", ".join(cells) + ")"


# k is the order key, c its customer key; t1..t3 are other orders of the same project.
_T = {"t1": "(k + 60 * (c % 4 + 1))", "t2": "(k + 60 * (c % 7))", "t3": "(k - 60)"}


def _expand(lines: list[tuple[str | None, str]]) -> list[tuple[str | None, str]]:
    out = []
    for cond, text in lines:
        for name, expr in _T.items():
            text = text.replace(f"<{name}>", expr)
        out.append((cond, text))
    return out


_JS = [
    (None, "import { a } from '../m[[<t1> % 13]]/f[[<t1>]]';"),
    ("k % 2 = 0", "import React from 'react';"),
    ("k % 4 = 1", "import {\n  b,\n} from './multi[[k]]';"),
    ("k % 5 = 0", 'import\ttype X\tfrom\t"../m[[<t2> % 13]]/f[[<t2>]]"'),
    ("k % 23 = 0", "import W from '../../m[[(k + 1380) % 13]]/w[[k + 1380]]';"),
    ("k % 6 = 0", "import\nlegacy from 'legacy[[k % 3]]'"),
    ("k % 3 = 1", "const lib = require('lib[[c % 9]]'), again = require(\"lib[[c % 9]]\");"),
    ("k % 8 = 3", "const lazy = () => import('./f[[<t3>]].ts');"),
    ("k % 10 = 7", "import Card from '@acme/m[[c % 13]]';"),
    ("k % 10 = 2", "import deep from 'kit/src/m[[c % 13]]/widgets';"),
    (None, "export function fn[[k]](a,\n  b) {\n  return a + b;\n}"),
    ("k % 3 = 0", "async function helper[[c]] (x) { return x; }"),
    ("k % 4 = 0", "export const arrow[[k]] = async (x, y) => x;"),
    ("k % 5 = 2", "const inner[[c]] = (\n  x\n) => { return x; };"),
    ("k % 5 = 2", "  function indented() {}"),
    ("k % 2 = 1", "export default class View[[k]] {}"),
    ("k % 4 = 2", "export default async function run[[k]]() {}"),
    ("k % 8 = 4", "export default {\n};"),
    ("k % 16 = 0", "export default new Store();"),
    ("k % 3 = 2", "export interface Props[[k]] {\n  id: string;\n}"),
    ("k % 5 = 3", "type Alias[[c]] = string;"),
    ("k % 6 = 4", "export abstract class Base[[k]] {}"),
    (None, "class Hidden[[c]] {}"),
    (None, "router.get('/x[[c]]', h); app.post(\"/y[[k]]\", h);"),
    ("k % 5 = 1", "router.delete(\n  '/z[[k]]',\n  h);"),
    ("k % 7 = 1", "  myapp.patch('/q[[c % 5]]', h);"),
    ("k % 9 = 0", "module.exports = { fn[[k]] };"),
    ("k % 6 = 1", "export { helper[[c]], Hidden[[c]] };"),
    ("k % 11 = 0", "export\x0bfunction ghost() {}\nx\rfunction cr() {}\néfunction nope() {}"),
    ("k % 13 = 0", "var s = 'export class'; export const tail[[k]] = 1;\nexport"),
]

_PY = [
    (None, "import lib[[c % 7]]"),
    ("k % 3 = 0", "import os, sys"),
    ("k % 2 = 0", "from .models import Thing"),
    ("k % 5 = 0", "from m[[k % 13]].f[[k]] import x"),
    ("k % 4 = 0", "import lib[[c % 7]]"),
    ("k % 10 = 3", "import corp.m[[c % 13]]"),
    ("k % 6 = 0", "    import indented"),
    (None, "@app.get('/r[[c]]')\ndef h[[k]](x):\n    return x"),
    ("k % 4 = 1", "@app.post(\"/s[[k]]\")\n@app.put('/t[[k]]')  # note\nasync def both[[k]](a, b):\n    pass"),
    ("k % 4 = 2", "@bp.route('/gap')\n\ndef gap[[k]]():\n    pass"),
    ("k % 4 = 3", "@login_required\ndef secure[[k]](a,\n        b):\n    pass"),
    ("k % 5 = 1", "@app.delete('/d[[c]]', tags=[1])\n@cached\ndef dd[[k]]():\n    pass"),
    (None, "def _p[[c]](a, b):\n    return a"),
    (None, "class C[[c]](Base):\n    def method(self):\n        pass"),
    ("k % 3 = 1", "class Wide[[k]](\n    A,\n    B):\n    pass"),
    ("k % 6 = 5", "class _Hidden:\n    pass"),
    ("k % 5 = 3", "class NoColon(Base)"),
    ("k % 11 = 0", "def é[[k]]():\n    pass\nx\rdef cr():\n    pass\nimport\x0bvt"),
    ("k % 5 = 4", "__all__ = ['h[[k]]', \"C[[c]]\",\n    '',  ]"),
    ("k % 10 = 4", "__all__ = ['never']"),
]

_DART = [
    (None, "import 'package:flutter/material.dart';"),
    (None, "import '../m[[<t1> % 13]]/f[[<t1>]].dart';"),
    ("k % 2 = 0", 'import "dart:io";'),
    ("k % 4 = 0", "import 'dart:io';"),
    ("k % 3 = 0", "export 'src/impl[[k]].dart';"),
    (None, "abstract class Repo[[k]] extends Base with Mix {\n  void method() {}\n}"),
    ("k % 3 = 1", "class _Priv[[c]] {}"),
    ("k % 5 = 1", "class Swallow[[k]] implements Foo\nclass Eaten[[k]] {\n}"),
    ("k % 2 = 1", "enum Color[[c]] { a, b }"),
    ("k % 3 = 2", "mixin Walk[[k]] on Base {}"),
    (None, "void main() {"),
    ("k % 4 = 1", "Future<void> gen[[k]]() async {}"),
    (None, "int add[[k]](int a, int b) => a + b;"),
    ("k % 4 = 2", "static  final String name[[c]] (x) async {"),
    ("k % 4 = 3", "if (x) {\nreturn (y) = z;\n\tint tabbed() {}"),
    ("k % 5 = 2", "_private[[c]]() {"),
    ("k % 5 = 3", "void split(int a,\n    int b) {"),
    (None, "  '/home[[k]]': (c) => Home[[c]](),"),
    ("k % 3 = 0", '  "/x[[c]]" : Page, \'/nohandler\': (c) {}'),
    ("k % 7 = 3", "  '/two[[c]]':\n    Wrapped,"),
]

# Lines marked with a leading "#" hold no declarations, only look like them.
_GO = [
    (None, "package m[[k % 13]]\n"),
    ("k % 2 = 0", 'import (\n\t"fmt"\n\talias "net/http"\n\n\t"example.com/mono/src/m[[c % 13]]"\n)'),
    ("k % 2 = 1", 'import "os"\nimport _ "corp/cmd/tool[[c % 5]]/x"'),
    ("k % 4 = 1", 'import "os"'),
    ("k % 3 = 0", "#// type Ghost struct {\n/*\nfunc ghost() {}\ntype Ghost struct {\n}\n*/"),
    ("k % 5 = 0", "#var tmpl = `\nfunc fake() {\n`"),
    (None, 'type T[[k]] struct {\n\tBase\n\t*Other\n\tA, B int // two\n\tC string `json:"c"`\n\tInner struct {\n\t\tDeep int\n\t}\n}'),
    ("k % 4 = 1", "type Store[[c]] interface {\n\tGet(key string) (string, error)\n\tio.Reader\n}"),
    ("k % 3 = 1", "type alias[[c]] = map[string]int"),
    ("k % 5 = 2", "type (\n\tPair[[k]] struct {\n\t\tX, Y int\n\t}\n\tid[[c]] int\n)"),
    ("k % 6 = 5", "type Point[[k]] struct{ X, Y int }"),
    (None, "func New[[k]](name string, port int) *T[[k]] {\n\treturn nil\n}"),
    (
        None,
        "func (t *T[[k]]) Serve[[c]](a, b int, opts ...string) (map[string]int, error) {\n"
        '\thttp.HandleFunc("/h[[k]]", t.handle)\n'
        '\tr.Get("/g[[c]]", func(w http.ResponseWriter) {})\n'
        '\tq := r.Header.Get("X-Id")\n}',
    ),
    ("k % 3 = 2", "func (t T[[k]]) handle() {\n\tmux.Handle(\"/m[[k]]\", wrap(t), t.last)\n\tr.Get(path, h)\n}"),
    (
        "k % 5 = 1",
        "func chain[[k]]() {\n\tr.With(auth).Get(\"/c[[k]]\", h.get).\n"
        '\t\tPost("/c[[c]]", wrap(h)).\n\t\tPut("/p[[c]]", h.put)\n\tr.Handle("/s[[k]]", t.last)\n}',
    ),
    ("k % 4 = 2", "func multi[[k]](\n\tctx context.Context,\n\tcb func(int) error,\n) error {\n\treturn nil\n}"),
    ("k % 6 = 0", "func Map[T any](xs []T) []T {\n\treturn xs\n}"),
    # syntax errors: an open body, an open literal, a wrong bracket, a statement by itself
    ("k % 53 = 0", "func cut[[k]]() {"),
    ("k % 59 = 0", 'var open[[k]] = "no end'),
    ("k % 61 = 0", "func wrong[[k]](a int] {\n}"),
    ("k % 67 = 0", "return [[k]]"),
]


def _go_lines(traps: bool) -> list[tuple[str | None, str]]:
    """With ``traps`` off, look-alike lines and comments are blank lines."""
    out = []
    for cond, text in _GO:
        if text.startswith("#"):
            text = text[1:] if traps else "\n" * text.count("\n")
        elif not traps:
            text = text.replace(" // two", " ")
        out.append((cond, text))
    return out


_PROJECT = "CASE WHEN k % 3 = 0 THEN 'mono' ELSE concat('p', CAST(k % 20 AS {string})) END"
_S = "CAST({} AS {{string}})".format

_ORDER_PATH = (
    "concat("
    f"CASE WHEN k % 37 = 0 THEN concat('services/s', {_S('k')}, '/') "
    f"WHEN k % 23 = 0 THEN concat('src/m', {_S('k % 13')}, '/w', {_S('k')}, '/') "
    f"WHEN k % 29 = 0 THEN 'node_modules/' WHEN k % 17 = 0 THEN '' "
    f"WHEN k % 19 = 0 THEN concat('cmd/tool', {_S('k % 5')}, '/') "
    f"ELSE concat('src/m', {_S('k % 13')}, '/') END, "
    "CASE WHEN k % 37 = 0 THEN CASE k % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'App' WHEN 2 THEN 'server' ELSE 'index' END "
    "WHEN k % 23 = 0 THEN 'index' "
    f"WHEN k % 43 = 0 THEN concat('0001_f', {_S('k')}) ELSE concat('f', {_S('k')}) END, "
    "CASE WHEN k % 7 = 0 THEN CASE WHEN k % 41 = 0 THEN '.PY' ELSE '.py' END "
    "WHEN k % 7 = 1 THEN CASE WHEN k % 9 = 0 THEN '.min.js' ELSE '.js' END "
    "WHEN k % 7 = 2 THEN '.ts' WHEN k % 7 = 3 THEN '.dart' WHEN k % 7 = 4 THEN '.go' "
    "WHEN k % 7 = 5 THEN CASE k % 5 WHEN 0 THEN '.jsx' WHEN 1 THEN '.mjs' WHEN 2 THEN '.cjs' ELSE '.tsx' END "
    "ELSE '.md' END)"
)


def _order_content(traps: bool) -> str:
    return (
        f"CASE k % 7 WHEN 0 THEN {_lines(_expand(_PY))} WHEN 3 THEN {_lines(_expand(_DART))} "
        f"WHEN 4 THEN {_lines(_expand(_go_lines(traps)))} ELSE {_lines(_expand(_JS))} END"
    )


_DOC_PATH = (
    f"concat('docs/m', {_S('k % 13')}, '/d', {_S('k')}, "
    "CASE k % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.dart' ELSE '.go' END)"
)


def _doc_content(traps: bool) -> str:
    """Whole prose between code lines; in Go it stands in a block comment."""
    prose = "body" if traps else "repeat(chr(10), CAST(length(body) - length(replace(body, chr(10), '')) AS INT))"
    opened, closed = ("/*", "*/") if traps else ("", "")
    py = f"concat({_text('import lib[[k % 7]]')}, chr(10), body, chr(10), {_text('class Doc[[k]](Base):')})"
    js = (
        f"concat({_text('import d from ' + chr(39) + './d[[k + 60]]' + chr(39) + ';')}, chr(10), body, chr(10), "
        f"{_text('export const doc[[k]] = (x) => x;')})"
    )
    dt = f"concat({_text('enum Doc[[k]] {}')}, chr(10), body, chr(10), {_text('void show[[k]]() {')})"
    go = (
        f"concat('package docs', chr(10), '{opened}', chr(10), {prose}, chr(10), '{closed}', chr(10), "
        f"{_text('func Doc[[k]]() {')}, chr(10), chr(125))"
    )
    return f"CASE k % 5 WHEN 0 THEN {py} WHEN 3 THEN {dt} WHEN 4 THEN {go} ELSE {js} END"


def _columns(path: str, content: str, string: str) -> list[str]:
    named = {"project": _PROJECT, "path": path, "content": content, "k": "k"}
    return [f"{expr.replace('{string}', string)} AS {name}" for name, expr in named.items()]


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # few narrow files of keys become many files of text: the keys are spread before the
    # texts are made, by number, since so few bytes would be put together again
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    orders = orders.repartition(parts, "o_orderkey")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = orders.selectExpr("o_orderkey AS k", "o_custkey AS c", "CAST(NULL AS STRING) AS body").unionAll(
        documents.selectExpr("doc_id AS k", "doc_id AS c", "coalesce(text, '') AS body")
    )

    def either(small: str, large: str) -> str:
        return f"CASE WHEN body IS NULL THEN {small} ELSE {large} END"

    path = either(_ORDER_PATH, _DOC_PATH)
    content = either(_order_content(True), _doc_content(True))
    return rows.selectExpr(*_columns(path, content, "STRING"))


def _keyed_sql(traps: bool) -> str:
    small = ", ".join(_columns(_ORDER_PATH, _order_content(traps), "VARCHAR"))
    large = ", ".join(_columns(_DOC_PATH, _doc_content(traps), "VARCHAR"))
    return (
        f"SELECT {small} FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders) "
        f"UNION ALL SELECT {large} FROM (SELECT doc_id AS k, coalesce(text, '') AS body FROM documents)"
    )


# The next revision of the corpus: some files go, some change, some are new.
_EDITED = (
    "CASE WHEN k % 10 = 0 THEN concat(content, chr(10), 'import added', chr(10), 'def added():') "
    "ELSE content END AS content"
)
_KEPT = "k % 31 <> 0"
_ADDED_PATH = "concat('new/', path) AS path"
_ADDED = "k % 37 = 0"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``project, path, content`` over all orders and all documents."""
    return _keyed(spark, sf_dir).drop("k")


def next_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _keyed(spark, sf_dir)
    return (
        keyed.filter(_KEPT)
        .selectExpr("project", "path", _EDITED)
        .unionAll(keyed.filter(_ADDED).selectExpr("project", _ADDED_PATH, "content"))
    )


def corpus_sql(traps: bool = True) -> str:
    """The same corpus as DuckDB SQL over the views ``orders`` and ``documents``."""
    return f"SELECT project, path, content FROM ({_keyed_sql(traps)})"


def next_corpus_sql(traps: bool = True) -> str:
    keyed = _keyed_sql(traps)
    return (
        f"SELECT project, path, {_EDITED} FROM ({keyed}) WHERE {_KEPT} "
        f"UNION ALL SELECT project, {_ADDED_PATH}, content FROM ({keyed}) WHERE {_ADDED}"
    )


# Model responses: one per conversation turn, in the shape of its provider.
# n picks the provider, m what is wrong or unusual, if anything.
_QUOTED = (
    "concat(chr(34), replace(replace(replace(CASE WHEN m = 3 THEN '  ' ELSE text END, "
    "chr(92), repeat(chr(92), 2)), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')), chr(34))"
)
# m = 6 quotes the number, m = 7 makes it a fraction; neither is a count
_IN = (
    f"CASE WHEN m = 6 THEN concat(chr(34), {_S('length(text)')}, chr(34)) "
    f"WHEN m = 7 THEN concat({_S('length(text)')}, '.5') ELSE {_S('length(text)')} END"
)
_OUT = _S("turn * 10 + 25")
_SHAPES = [
    (
        "n IN (1, 3, 4)",
        '{"choices":[', '{"message":{"content":', "}}", "]",
        f"""concat(',"usage":{{"prompt_tokens":', {_IN}, ',"completion_tokens":', {_OUT}, ',"total_tokens":', {_S('length(text) + turn * 10 + 25')}, '}}')""",
    ),
    (
        "n = 2",
        '{"candidates":[', '{"content":{"parts":[{"text":', "}]}}", "]",
        f"""concat(',"usageMetadata":{{"promptTokenCount":', {_IN}, ',"candidatesTokenCount":', {_OUT}, ',"totalTokenCount":', {_S('length(text) + 7')}, '}}')""",
    ),
    (
        "n = 5",
        '{"response":', "", "", "",
        f"""concat(',"prompt_eval_count":', {_IN}, ',"eval_count":', {_OUT})""",
    ),
    (
        None,
        '{"content":[', '{"text":', "}", "]",
        f"""concat(',"usage":{{"input_tokens":', {_IN}, ',"output_tokens":', {_OUT}, '}}')""",
    ),
]


def _response() -> str:
    cases = []
    for cond, head, before, after, tail, usage in _SHAPES:
        # m = 8 repeats a member of what is not read, m = 9 the first one that is, m = 10
        # writes that in another case: decoders take the last of a name in any case
        _, key, rest = head.split('"', 2)
        earlier = '"first"' if not before else "[]"
        head = (
            f"""CASE m WHEN 8 THEN '{{"other":{{"a":1,"a":2}},"{key}' WHEN 9 THEN '{{"{key}":{earlier},"{key}' """
            f"""WHEN 10 THEN '{{"{key.capitalize()}' ELSE '{{"{key}' END, '"{rest}'"""
        )
        nothing = "chr(34), chr(34)" if not before else "''"
        body = (
            f"concat({head}, CASE WHEN m = 1 THEN concat({nothing}) "
            f"ELSE concat('{before}', {_QUOTED}, '{after}') END, '{tail}', "
            f"CASE WHEN m = 4 THEN '' ELSE {usage} END, CASE WHEN m = 2 THEN '' WHEN m = 5 THEN '}} trailing' ELSE '}}' END)"
        )
        cases.append(f"ELSE {body}" if cond is None else f"WHEN {cond} THEN {body}")
    return f"CASE {' '.join(cases)} END"


def _responses(string: str) -> list[str]:
    provider = (
        "CASE n WHEN 0 THEN 'claude' WHEN 1 THEN 'openai' WHEN 2 THEN 'gemini' "
        "WHEN 3 THEN 'deepseek' WHEN 4 THEN 'mistral' WHEN 5 THEN 'ollama' ELSE 'other' END"
    )
    named = {
        "conv_id": "conv_id",
        "turn": "turn",
        "project": _PROJECT.replace("k %", "conv_id %"),
        "provider": provider,
        "model": "concat('model-', CAST(n AS {string}))",
        "response": f"CASE WHEN m = 0 THEN NULL ELSE {_response()} END",
        "error": "CASE WHEN m = 0 THEN 'API error 500' END",
    }
    return [f"{expr.replace('{string}', string)} AS {name}" for name, expr in named.items()]


_PICKS = ("conv_id", "turn", "text", "(conv_id + turn) % 7 AS n", "(conv_id * 7 + turn * 3) % 11 AS m")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, project, provider, model, response, error``."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return table.selectExpr(*_PICKS).selectExpr(*_responses("STRING"))


def responses_sql() -> str:
    picked = f"SELECT {', '.join(_PICKS)} FROM conversations"
    return f"SELECT {', '.join(_responses('VARCHAR'))} FROM ({picked})"
