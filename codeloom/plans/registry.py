"""The named queries: each maps ``(spark, sf_dir)`` to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators import extract, graph, incremental, report, scan, summaries
from codeloom.plans.workspace import Workspace
from codeloom.session import discard, new_stage_path, stage, stage_at
from codeloom.sources import derived
from codeloom.sources.sinks import FORMAT_NAMES, write_outputs
from codeloom.sources.snapshot import SnapshotStore
from codeloom.streaming.watch import VERSION_SCHEMA, WatchStore, watch_sources

Query = Callable[[SparkSession, str], DataFrame]

GENERATED_AT = "2024-01-01T00:00:00Z"


def _on(build: Callable[[Workspace], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(Workspace.of(spark, sf_dir))


def _counts(nodes: DataFrame, *keep: str) -> DataFrame:
    sizes = [
        F.size(name).cast("long").alias(name)
        for name in ("functions", "imports", "exports", "api_routes", "types")
    ]
    return nodes.select("project", "path", *keep, "language", *sizes)


def _scan_sources(w: Workspace) -> DataFrame:
    return w.corpus.select(
        "project", "path", F.length("content").cast("long").alias("n_chars"),
        F.md5("content").alias("digest"),
    )


def _fact_rows(w: Workspace) -> DataFrame:
    return extract.facts(w.passing_nodes).select(
        "project", "path", "language", "kind", "name", "line", "ord", "exported"
    )


def _merge_nodes(w: Workspace) -> DataFrame:
    """Each revision is extracted in one pass from the tables; the fresh nodes are read twice."""
    fresh = stage(extract.file_nodes(w.next_files), "fresh-nodes")
    return _counts(incremental.merge_nodes(w.passing_nodes, fresh))


def _incremental_refresh(w: Workspace) -> DataFrame:
    """Refreshes from a snapshot with digests, so the old contents are not read again.
    Nodes that are not staged yet are written once, into the snapshot."""
    store = SnapshotStore(w.spark, new_stage_path(w.spark, "refresh"))
    digests = incremental.digests(w.corpus)
    store.save(nodes=w.passing_nodes, digests=digests)
    refreshed = incremental.incremental_refresh(store.load("nodes"), store.load("digests"), w.next_corpus)
    return _counts(refreshed)


def _refresh_by_content(w: Workspace) -> DataFrame:
    """The next revision from a bucketed snapshot: the first one's nodes and the new files."""
    buckets = int(w.spark.conf.get("spark.sql.shuffle.partitions"))
    store = SnapshotStore(w.spark, new_stage_path(w.spark, "by-content"), buckets)
    # texts take fewer bytes than the rows of their symbols, so the texts are dealt out
    nodes = incremental.nodes_with_digest(store.deal(w.files))
    store.save(dealt=("nodes",), nodes=nodes, files=w.next_corpus)
    refreshed = incremental.refresh_by_content(store.load("nodes"), store.load("files"))
    return _counts(refreshed.nodes)


def _snapshot_io(w: Workspace) -> DataFrame:
    """Two saved versions, of which the second is read back."""
    store = SnapshotStore(w.spark, new_stage_path(w.spark, "snapshots"))
    store.save(nodes=w.nodes.filter(F.col("language") == "Go"))
    store.save(nodes=w.nodes)
    return _counts(store.load("nodes"))


def _counted_file(text: Column) -> Column:
    """A file's object in the JSON context as its path, language and numbers of members;
    any other line as it is."""
    names = ("functions", "imports", "exports", "api_routes", "types")
    parsed = F.from_json(
        F.ltrim(text, F.lit(",")),
        "path string, language string, "
        + ", ".join(f"{n} array<{'string' if n in ('imports', 'exports') else 'struct<line int>'}>" for n in names),
    )
    comma = F.when(text.startswith(","), ",").otherwise("")

    def counted(file: Column) -> Column:
        sizes = [F.coalesce(F.size(file[n]), F.lit(0)) for n in names]
        return F.concat(comma, F.concat_ws("|", file["path"], file["language"], *sizes))

    # bound, so that a line is parsed once
    once = F.get(F.transform(F.array(parsed), counted), F.lit(0))
    return F.when(text.rlike(r'^,?\{"path":'), once).otherwise(text)


def _write_outputs(w: Workspace) -> DataFrame:
    """The files of all projects in all three formats, read back as numbered lines.

    A line's number counts the lines of the earlier parts of its project and those
    before it in its own part, so lines are numbered per part and never per project. A
    file's object becomes its counts where it is read, so that its text is not shuffled.
    The files are compressed, and the lines of one format are staged at a time: the
    texts are many times the size of the corpus.
    """
    out = new_stage_path(w.spark, "outputs")
    reports = {
        "markdown": lambda: report.markdown_report(w.nodes, w.edges, GENERATED_AT),
        "mmd": lambda: graph.mermaid_lines(w.graph_nodes, w.edges),
        "json": lambda: report.context_json(w.nodes, w.edges, GENERATED_AT),
    }
    paths = []
    for name, build in reports.items():
        kept = new_stage_path(w.spark, f"{name}-lines")
        lines = stage_at(build(), kept)
        paths += write_outputs({FORMAT_NAMES[name]: lines}, (name,), out, compression="gzip")
        discard(w.spark, kept)
    lines, text = None, F.col("value")
    for path in paths:
        name = path.rsplit("/", 1)[1]
        read = w.spark.read.schema("value string, project string").text(path).select(
            "project", F.lit(name).alias("format"),
            (_counted_file(text) if name == "json" else text).alias("text"),
            F.concat_ws("/", "_metadata.file_name", F.format_string("%012d", "_metadata.file_block_start")).alias("part"),
            F.monotonically_increasing_id().alias("place"),
        )
        lines = read if lines is None else lines.unionByName(read)
    key = ["project", "format"]
    parts = lines.groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = parts.select(
        *key, "part",
        (F.sum("n").over(Window.partitionBy(*key).orderBy("part")) - F.col("n")).alias("before"),
    )
    inside = F.row_number().over(Window.partitionBy(*key, "part").orderBy("place"))
    numbered = lines.withColumn("inside", inside).join(before, [*key, "part"])
    return numbered.select(*key, (F.col("before") + F.col("inside")).alias("line"), "text")


def _watch_sources(w: Workspace) -> DataFrame:
    """Both revisions as file versions, the newer one first, so that every
    version of the second run arrives late."""
    spark, root = w.spark, new_stage_path(w.spark, "watch")
    newer = w.next_corpus
    gone = w.corpus.select("project", "path").join(
        newer.select("project", "path"), ["project", "path"], "left_anti"
    )
    versions = {
        2: newer.unionByName(gone.withColumn("content", F.lit(None).cast("string"))),
        1: w.corpus,
    }
    store = WatchStore(spark, f"{root}/store")
    for seq, files in versions.items():
        arrived = files.withColumn("seq", F.lit(seq).cast("long"))
        arrived.select("project", "path", "seq", "content").write.mode("append").parquet(
            f"{root}/input"
        )
        stream = spark.readStream.schema(VERSION_SCHEMA).parquet(f"{root}/input")
        watch_sources(store, stream, f"{root}/checkpoint").awaitTermination()
    return _counts(store.current(), "seq")


def _usage(w: Workspace) -> DataFrame:
    return summaries.normalize_usage(derived.responses(w.spark, w.sf_dir))


def _costs(w: Workspace) -> DataFrame:
    return summaries.usage_cost(_usage(w))


def _summary_fallback(w: Workspace) -> DataFrame:
    """Each project's last answer per provider, against the structural sentence."""
    last = (
        _usage(w)
        .groupBy("project", "provider")
        .agg(F.max_by(F.struct("text", "error"), F.struct("conv_id", "turn")).alias("last"))
        .select("project", "provider", "last.text", "last.error")
    )
    structural = report.structural_summary(w.nodes, w.edges)
    return summaries.summary_fallback(structural.select("project"), last, structural, "claude")


def _payload_pieces(w: Workspace) -> DataFrame:
    pieces = summaries.request_payloads(summaries.build_prompts(w.nodes, w.edges))
    return pieces.withColumn("text", F.md5("text"))


def _context_lines(w: Workspace) -> DataFrame:
    lines = report.context_json(w.nodes, w.edges, GENERATED_AT)
    return _lines(lines.withColumn("text", _counted_file(F.col("text"))))


def _lines(lines: DataFrame) -> DataFrame:
    return lines.select("project", "section", "file", "seq", "text")


def _edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select("project", "from_id", "to_id", "type", "from_path", "to_path", "ord")


QUERIES: dict[str, Query] = {
    # scanning
    "scan_sources": _on(_scan_sources),
    "ignore_filter": _on(lambda w: scan.ignore_filter(w.corpus).select("project", "path")),
    "language_classify": _on(
        lambda w: scan.language_classify(w.corpus).select("project", "path", "language")
    ),
    "source_lines": _on(
        lambda w: scan.source_lines(w.files).select(
            "project", "path", "line", F.md5("txt").alias("digest")
        )
    ),
    # extraction
    **{
        name: _on(lambda w, op=op: op(w.files))
        for name, op in {
            "js_imports": extract.js_imports,
            "js_exports": extract.js_exports,
            "js_functions": extract.js_functions,
            "js_types": extract.js_types,
            "js_routes": extract.js_routes,
            "js_exported_flag": extract.js_exported_flag,
            "py_imports": extract.py_imports,
            "py_functions": extract.py_functions,
            "py_routes": extract.py_routes,
            "py_classes": extract.py_classes,
            "py_exports": extract.py_exports,
            "dart_imports": extract.dart_imports,
            "dart_functions": extract.dart_functions,
            "dart_types": extract.dart_types,
            "dart_exports": extract.dart_exports,
            "dart_routes": extract.dart_routes,
            "go_imports": extract.go_imports,
            "go_functions": extract.go_functions,
            "go_types": extract.go_types,
            "go_exports": extract.go_exports,
            "go_routes": extract.go_routes,
        }.items()
    },
    "file_nodes": _on(lambda w: _counts(extract.file_nodes(w.files))),
    "facts": _on(_fact_rows),
    # graph
    "node_ids": _on(lambda w: graph.node_ids(w.passing_nodes)),
    "module_nodes": _on(lambda w: graph.module_nodes(w.passing_nodes)),
    "type_nodes": _on(lambda w: graph.type_nodes(w.passing_nodes)),
    "api_nodes": _on(lambda w: graph.api_nodes(w.passing_nodes)),
    "resolve_relative": _on(
        lambda w: graph.resolve_relative(graph.imports(w.importing_nodes), w.importing_nodes)
    ),
    "resolve_package": _on(
        lambda w: graph.resolve_package(graph.imports(w.importing_nodes), w.importing_nodes)
    ),
    "resolve_package_with_root": _on(
        lambda w: graph.resolve_package(
            graph.imports(w.importing_nodes), w.importing_nodes, include_root_dir=True
        )
    ),
    "import_edges": _on(lambda w: _edge_rows(graph.import_edges(w.importing_nodes))),
    "mermaid_lines": _on(lambda w: _lines(graph.mermaid_lines(w.graph_nodes, w.edges))),
    "graph_summary": _on(lambda w: graph.graph_summary(w.nodes, w.edges)),
    "relationship_lines": _on(lambda w: graph.relationship_lines(w.edges)),
    "dependency_depth": _on(lambda w: graph.dependency_depth(w.nodes, w.edges)),
    # snapshots and streams
    "changed_files": _on(
        lambda w: incremental.changed_files(w.corpus, w.next_corpus)
    ),
    "merge_nodes": _on(_merge_nodes),
    "incremental_refresh": _on(_incremental_refresh),
    "refresh_by_content": _on(_refresh_by_content),
    "snapshot_io": _on(_snapshot_io),
    "watch_sources": _on(_watch_sources),
    # reports
    "language_counts": _on(lambda w: report.language_counts(w.passing_nodes)),
    "project_totals": _on(
        lambda w: report.project_totals(w.nodes, w.edges).select(
            "project", "files", "languages", "functions", "types", "routes", "edges"
        )
    ),
    "entry_points": _on(lambda w: report.entry_points(w.passing_nodes)),
    "entry_points_prompt": _on(lambda w: report.entry_points_prompt(w.passing_nodes)),
    "route_listing": _on(lambda w: report.route_listing(w.passing_nodes)),
    "key_types": _on(lambda w: report.key_types(w.passing_nodes)),
    "markdown_report": _on(
        lambda w: _lines(report.markdown_report(w.nodes, w.edges, GENERATED_AT))
    ),
    "context_json": _on(_context_lines),
    "write_outputs": _on(_write_outputs),
    "structural_summary": _on(lambda w: report.structural_summary(w.nodes, w.edges)),
    "run_stats": _on(lambda w: report.run_stats(w.nodes, w.edges)),
    # model-written summaries
    "build_prompts": _on(lambda w: _lines(summaries.build_prompts(w.nodes, w.edges))),
    "request_payloads": _on(_payload_pieces),
    "normalize_usage": _on(_usage),
    "usage_cost": _on(
        lambda w: _costs(w).select(
            "conv_id", "turn", "provider", F.round("cost", 9).alias("cost")
        )
    ),
    "cost_string": _on(
        lambda w: summaries.cost_string(_costs(w)).select("conv_id", "turn", "cost_text")
    ),
    "cost_totals": _on(
        lambda w: summaries.cost_totals(_costs(w)).withColumn("cost", F.round("cost", 9))
    ),
    "summary_fallback": _on(_summary_fallback),
}


def module_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files and import edges each project has."""
    w = Workspace.of(spark, sf_dir)
    return graph.graph_summary(w.nodes, w.edges).select("project", "modules", "dependencies")
