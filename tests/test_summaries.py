import json
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph, report, summaries
from codeloom.session import stage

TEXTS = {
    "main.go": "package main\n\nfunc main() {\n}\n",
    "lib/app.js": "import u from './util';\nexport function boot() {}\n",
    "lib/util.js": "export function util() {}\nfunction hidden() {}\n",
}

PROMPT = """You are analyzing a software project called "p".
Below is the structural analysis of the codebase:

Files analyzed: 3
Languages: Go (1 files), JavaScript (2 files)
Entry points: lib/app.js, main.go

File structure and relationships:
Graph summary:
  Modules: 3
  Types: 0
  API routes: 0
  Dependencies: 1

Key relationships:
  lib_app_js --imports--> lib_util_js


Key functions and modules:
- lib/app.js: boot()
- lib/util.js: util()

""" + summaries.INSTRUCTIONS.format(language="de")


@pytest.fixture(scope="module")
def tables(nodes_of):
    nodes = nodes_of(TEXTS)
    return nodes, stage(graph.import_edges(nodes), "test-edges")


def joined(pieces):
    return "".join(r.text for r in pieces.orderBy("section", "file", "seq").collect())


def test_prompt(tables):
    assert joined(summaries.build_prompts(*tables, language="de")) == PROMPT


def test_project_names_are_quoted(nodes_of, files):
    nodes = nodes_of([('a"b\\c', "x/a.py", "")])
    prompt = joined(summaries.build_prompts(nodes, graph.import_edges(nodes)))
    assert prompt.startswith('You are analyzing a software project called "a\\"b\\\\c".\n')
    assert "Entry points" not in prompt


def test_payloads(tables):
    prompts = summaries.build_prompts(*tables)
    text, pieces = joined(prompts), summaries.request_payloads(prompts)
    rows = {p: json.loads(joined(pieces.filter(F.col("provider") == p))) for p in summaries.MODELS}
    chat = {"max_tokens": 4096, "messages": [{"content": text, "role": "user"}]}
    assert rows == {
        "claude": {**chat, "model": "claude-sonnet-4-5-20250514"},
        "openai": {**chat, "model": "gpt-4o"},
        "deepseek": {**chat, "model": "deepseek-chat"},
        "mistral": {**chat, "model": "mistral-large-latest"},
        "gemini": {"contents": [{"parts": [{"text": text}]}], "generationConfig": {"maxOutputTokens": 4096}},
        "ollama": {"model": "llama3", "prompt": text, "stream": False},
    }


def test_responses(spark):
    cases = {
        ("claude", '{"content":[{"text":"hi"}],"usage":{"input_tokens":3,"output_tokens":4}}', None): ("hi", 3, 4, 7, None),
        ("claude", '{"content":[]}', None): (None, None, None, None, "empty response"),
        ("claude", '{"content":[{"text":"hi"}]}', None): ("hi", 0, 0, 0, None),
        ("openai", '{"choices":[{"message":{"content":"a"}}],"usage":{"prompt_tokens":1,"completion_tokens":2,"total_tokens":9}}', None): ("a", 1, 2, 9, None),
        ("mistral", '{"choices":[{"message":{}}]}', None): ("", 0, 0, 0, None),
        ("deepseek", '{"choices":', None): (None, None, None, None, "unreadable response"),
        ("ollama", '{"response":"x","prompt_eval_count":1} trailing', None): (None, None, None, None, "unreadable response"),
        ("ollama", '{"response":"x"},{"response":"y"}', None): (None, None, None, None, "unreadable response"),
        ("claude", '{"content":[{"text":"hi"}],"usage":{"input_tokens":"12"}}', None): (None, None, None, None, "unreadable response"),
        ("openai", '{"choices":[{"message":{}}],"usage":{"prompt_tokens":1.5}}', None): (None, None, None, None, "unreadable response"),
        ("gemini", '{"candidates":[{"content":{"parts":[{"text":"g"}]}}],"usageMetadata":{"promptTokenCount":5,"candidatesTokenCount":6,"totalTokenCount":12}}', None): ("g", 5, 6, 12, None),
        ("gemini", '{"candidates":[{"content":{}}]}', None): (None, None, None, None, "empty response"),
        ("gemini", '{"candidates":[]}', None): (None, None, None, None, "empty response"),
        ("ollama", '{"response":"o","prompt_eval_count":8,"eval_count":2}', None): ("o", 8, 2, 10, None),
        ("ollama", '{"response":""}', None): (None, None, None, None, "empty response"),
        ("ollama", None, "timeout"): (None, None, None, None, "timeout"),
        ("other", '{"response":"x"}', None): (None, None, None, None, "unknown provider"),
        ("ollama", '{"response":"x","response":"y","eval_count":2,"eval_count":3}', None): ("y", 0, 3, 3, None),
        ("ollama", '{"other":{"a":1,"a":2},"response":"x"}', None): ("x", 0, 0, 0, None),
        ("ollama", '{"Response":"x","EVAL_COUNT":4}', None): ("x", 0, 4, 4, None),
        ("gemini", '{"Candidates":[{"CONTENT":{"parts":[{"text":"Text: \\"Usage\\" : y"}]}}],"usagemetadata":{"TotalTokenCount":7}}', None): ('Text: "Usage" : y', 0, 0, 7, None),
        ("claude", '{"content":[{"text":"a"}]} {"content":[]}', None): (None, None, None, None, "unreadable response"),
        ("claude", '{"content":[{"text":"a"}]}],[1', None): (None, None, None, None, "unreadable response"),
        ("claude", "{'content':[{'text':'a'}]}", None): (None, None, None, None, "unreadable response"),
        ("claude", '{"content":[{"text":"a"}], "x": NaN}', None): (None, None, None, None, "unreadable response"),
        ("claude", '[{"content":[{"text":"a"}]}]', None): (None, None, None, None, "unreadable response"),
        ("claude", ' {"content":[{"text":"a"}]}\n', None): ("a", 0, 0, 0, None),
        ("claude", "", None): (None, None, None, None, "unreadable response"),
        ("claude", "<html>", None): (None, None, None, None, "unreadable response"),
        ("claude", None, None): (None, None, None, None, "unreadable response"),
    }
    rows = [(str(i), *case) for i, case in enumerate(cases)]
    table = spark.createDataFrame(rows, "project string, provider string, response string, error string").withColumn("model", F.lit("m"))
    got = {int(r.project): (r.text, r.input_tokens, r.output_tokens, r.total_tokens, r.error)
           for r in summaries.normalize_usage(table).collect()}
    assert got == dict(enumerate(cases.values()))


def test_cost_text_rounds_like_exact_binary(spark):
    rng = random.Random(3)
    usage = [(rng.choice(list(summaries.PRICES)), rng.randint(0, 3000), rng.randint(0, 3000)) for _ in range(3000)]
    usage += [("mistral", 25, 0), ("mistral", 75, 0), ("gemini", 40, 0), ("claude", 50, 0), ("claude", 10, 8), ("nobody", 5, 5)]
    usage += [("mistral", 50 * i + 25, 0) for i in range(2000)]
    table = spark.createDataFrame(usage, "provider string, input_tokens long, output_tokens long")
    rows = summaries.cost_string(summaries.usage_cost(table)).collect()
    assert len(rows) == len(usage)
    for r in rows:
        rates = summaries.PRICES.get(r.provider, (0.0, 0.0))
        cost = (r.input_tokens * rates[0] + r.output_tokens * rates[1]) / 1_000_000
        assert r.cost == cost
        assert r.cost_text == ("Free (local)" if cost == 0 else f"${cost:.4f} ({r.provider})")


def test_no_usage(spark):
    table = spark.createDataFrame([("claude", None, None)], "provider string, input_tokens long, output_tokens long")
    assert summaries.cost_string(summaries.usage_cost(table)).first().cost_text == "N/A"


def test_fallback(spark):
    projects = [("ok",), ("blank",), ("failed",), ("fallback blank",), ("both failed",), ("silent",)]
    answers = [
        ("ok", "claude", "good", None), ("ok", "ollama", "other", None),
        ("blank", "claude", " \n\t", None), ("blank", "ollama", "local", None),
        ("failed", "claude", None, "500"), ("failed", "ollama", "local", None),
        ("fallback blank", "claude", None, "500"), ("fallback blank", "ollama", "", None),
        ("both failed", "claude", None, "500"), ("both failed", "ollama", None, "down"),
    ]
    p = spark.createDataFrame(projects, "project string")
    s = spark.createDataFrame(answers, "project string, provider string, text string, error string")
    rows = summaries.summary_fallback(p, s, p.withColumn("summary", F.lit("plain")), "claude").collect()
    assert {r.project: (r.chosen_tier, r.summary) for r in rows} == {
        "ok": ("primary", "good"), "blank": ("fallback", "local"), "failed": ("fallback", "local"),
        "fallback blank": ("fallback", ""), "both failed": ("structural", "plain"), "silent": ("structural", "plain"),
    }


def test_quoted_names(spark):
    cases = {
        "plain": "plain", 'a"b\\c': 'a\\"b\\\\c', "t\tn\nr\rv\vf\fb\ba\a": "t\\tn\\nr\\rv\\vf\\fb\\ba\\a",
        "\x00\x1f\x7f": "\\x00\\x1f\\x7f", "\u00e9\u4e94\U0001f600": "\u00e9\u4e94\U0001f600",
        "\u00a0\u00ad\u200b\ufeff": "\\u00a0\\u00ad\\u200b\\ufeff", "\U000e0001\n": "\\U000e0001\\n", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", summaries.quoted(F.col("t")).alias("q"))
    assert {r.t: r.q for r in rows.collect()} == cases
