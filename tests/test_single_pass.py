"""Queries that extract, stage and shuffle no more than they read."""

import datetime

import pytest

from codeloom.operators import extract, report, scan, skew
from codeloom.plans import registry
from codeloom.plans.workspace import Workspace


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def tables(spark, tmp_path):
    """Orders and documents with a key that is null and one that comes twice."""
    keys = [*range(200), 37, None]
    day = datetime.datetime(2024, 1, 1)
    orders = [(k, None if k is None else k % 15, "O", 1.0, day, "1-URGENT") for k in keys]
    spark.createDataFrame(
        orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    documents = [(k, f"some words\nof text {k}", "en", "web", 20) for k in range(20)] + [(20, None, "en", "web", 0)]
    spark.createDataFrame(
        documents, "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    yield str(tmp_path)
    Workspace.forget(spark, str(tmp_path))


def staged(spark, sf_dir):
    return set(Workspace.of(spark, sf_dir)._tables)


@pytest.mark.parametrize("name", ["mermaid_lines", "resolve_package_with_root"])
def test_graph_queries_extract_what_they_read(spark, tables, name):
    alone = rows_of(registry.QUERIES[name](spark, tables))
    kept = staged(spark, tables)
    assert "file-nodes" not in kept and "corpus" not in kept
    Workspace.forget(spark, tables)
    w = Workspace.of(spark, tables)
    w.nodes
    assert rows_of(registry.QUERIES[name](spark, tables)) == alone != []
    assert not {"imports", "graph-symbols"} & staged(spark, tables)


def test_symbols_are_taken_from_what_is_staged(spark, tables):
    w = Workspace.of(spark, tables)
    w.graph_nodes
    w.edges
    assert staged(spark, tables) == {"graph-symbols", "edges"}
    assert "functions" in w.symbols("functions").columns


def test_merge_extracts_each_revision_from_the_tables(spark, tables):
    alone = rows_of(registry.QUERIES["merge_nodes"](spark, tables))
    assert not {"corpus", "next-corpus", "file-nodes"} & staged(spark, tables)
    w = Workspace.of(spark, tables)
    fresh = extract.file_nodes(scan.source_files(w.next_corpus))
    gone = w.nodes.join(fresh, ["project", "path"], "left_anti")
    assert rows_of(registry._counts(fresh.unionByName(gone))) == alone != []


def test_context_lines_are_not_shuffled(spark, tables, monkeypatch):
    w = Workspace.of(spark, tables)
    nodes, edges = w.nodes, w.edges
    small = report.context_json(nodes, edges, "now")
    assert "_salt" not in plan(small)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    large = report.context_json(nodes, edges, "now")
    assert "_salt" in plan(large)
    assert rows_of(small) == rows_of(large) != []


def test_file_objects_are_parsed_once(spark):
    text = '{"path":"a","language":"Go","imports":["x","y"],"types":[{"line":1}]}'
    df = spark.createDataFrame([(text,), ("," + text,), ('],"graph":{',)], "text string")
    counted = df.select(registry._counted_file(df["text"]).alias("text"))
    assert [r[0] for r in counted.collect()] == ["a|Go|0|2|0|0|1", ",a|Go|0|2|0|0|1", '],"graph":{']
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_written_files_are_counted_before_the_shuffle(spark, tables):
    df = registry.QUERIES["write_outputs"](spark, tables)
    steps = df._jdf.queryExecution().optimizedPlan().toString()
    assert steps.index("row_number()") < steps.index("from_json")
    found = {}
    for project, kind, line, text in df.collect():
        found.setdefault((project, kind), {})[line] = text
    assert all(sorted(lines) == list(range(1, len(lines) + 1)) for lines in found.values())
    w = Workspace.of(spark, tables)
    lines = report.markdown_report(w.nodes, w.edges, registry.GENERATED_AT).collect()
    ordered = sorted(lines, key=lambda r: (r.project, r.section, r.file, r.seq))
    project = next(p for p, kind in found if kind == "md")
    assert [r.text for r in ordered if r.project == project] == [t for _, t in sorted(found[project, "md"].items())]
