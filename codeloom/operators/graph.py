"""The dependency graph as node and edge tables.

All joins are on project and path, never on the display id, which can collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import skew
from codeloom.session import stage

# What the nodes of a file are named by.
_NAMES = {"module": (), "type": ("name",), "api": ("method", "path")}


def node_ids(nodes: DataFrame) -> DataFrame:
    return nodes.select("project", "path", paths.node_id(F.col("path")).alias("id"))


def _module(path: Column) -> Column:
    return F.struct(
        paths.node_id(path).alias("id"),
        paths.basename(path).alias("label"),
        F.lit("module").alias("type"),
        path.alias("file"),
    )


def _type(path: Column, t: Column) -> Column:
    return F.struct(
        paths.node_id(F.concat(path, F.lit(":"), t["name"])).alias("id"),
        t["name"].alias("label"),
        F.lit("type").alias("type"),
        path.alias("file"),
    )


def _api(path: Column, r: Column) -> Column:
    return F.struct(
        paths.node_id(F.concat_ws(":", path, r["method"], r["path"])).alias("id"),
        F.concat_ws(" ", r["method"], r["path"]).alias("label"),
        F.lit("api").alias("type"),
        path.alias("file"),
    )


def _exported_types() -> Column:
    return F.filter("types", lambda t: t["exported"])


def module_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("project", _module(F.col("path")).alias("n")).select("project", "n.*")


def type_nodes(nodes: DataFrame) -> DataFrame:
    path = F.col("path")
    return nodes.select("project", F.inline(F.transform(_exported_types(), lambda t: _type(path, t))))


def api_nodes(nodes: DataFrame) -> DataFrame:
    path = F.col("path")
    return nodes.select("project", F.inline(F.transform("api_routes", lambda r: _api(path, r))))


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """All nodes in one pass over the files; ``ord`` orders the nodes of a file."""
    path, kind = F.col("path"), F.col("n.type")

    def named(kind: str, *columns: Column) -> Column:
        none = F.lit(None).cast("string")
        values = dict(zip(_NAMES[kind], columns))
        return F.struct(
            F.lit(kind).alias("type"), *[values.get(n, none).alias(n) for n in ("name", "method", "path")]
        )

    # only names are unfolded; ids and labels are made behind, where they are read
    each = F.concat(
        F.array(named("module")),
        F.transform(_exported_types(), lambda t: named("type", t["name"])),
        F.transform("api_routes", lambda r: named("api", r["method"], r["path"])),
    )
    made = {"type": _type(path, F.col("n")), "api": _api(path, F.col("n"))}
    columns = [
        F.when(kind == "type", made["type"][c]).when(kind == "api", made["api"][c]).otherwise(_module(path)[c]).alias(c)
        for c in ("id", "label")
    ]
    return nodes.select("project", "path", F.posexplode(each).alias("ord", "n")).select(
        "project", *columns, kind.alias("type"), path.alias("file"), "ord"
    )


def imports(nodes: DataFrame) -> DataFrame:
    return nodes.select("project", "path", F.posexplode("imports").alias("ord", "import"))


def relative_imports(imports: DataFrame) -> DataFrame:
    joined = paths.join_clean(paths.dirname(F.col("path")), F.col("import"))
    return imports.filter(F.col("import").startswith(".")).withColumn("stem", joined)


def stem_index(nodes: DataFrame) -> DataFrame:
    """The one file each relative import text finds: the best-ranked of its files.

    Keying the files by what an import may leave off keeps the import side at
    one row per import, and makes the resolution a plain equi-join.
    """
    return (
        nodes.select("project", "path", F.inline(paths.import_stems(F.col("path"))))
        .groupBy("project", "stem")
        .agg(F.min(F.struct("rank", "path")).alias("best"))
        .select("project", "stem", F.col("best.path").alias("to_path"))
    )


def resolve_relative(imports: DataFrame, nodes: DataFrame, **probe: int) -> DataFrame:
    """``project, path, ord, import, to_path`` of every relative import;
    ``to_path`` is null where no file fits."""
    return skew.lookup(
        relative_imports(imports),
        stem_index(nodes),
        ["project", "stem"],
        ["project", "path"],
        **probe,
    ).select("project", "path", "ord", "import", "to_path")


def package_index(nodes: DataFrame, include_root_dir: bool = False) -> DataFrame:
    """``project, key, rule, best``: what must occur in an import (rule 1: the
    directory) or end it (rule 0: its last name), and the best file for it."""
    directory = F.col("dir")
    dirs = nodes.select("project", paths.dirname(F.col("path")).alias("dir"), "path")
    if not include_root_dir:
        dirs = dirs.filter(directory != ".")
    best = F.struct((-F.length(directory)).alias("order"), F.col("path").alias("path"))
    rules = F.array(
        F.struct(paths.basename(directory).alias("key"), F.lit(0).alias("rule")),
        F.struct(directory.alias("key"), F.lit(1).alias("rule")),
    )
    return (
        dirs.groupBy("project", "dir")
        .agg(F.min("path").alias("path"))
        .select("project", best.alias("best"), F.inline(rules))
        .groupBy("project", "key", "rule")
        .agg(F.min("best").alias("best"))
    )


# Characters of the shortest and the longest grams under which directories are filed; the
# lengths between are doubled ones.
GRAM, LONGEST_GRAM = 4, 64


def _grams(text: Column, size: int) -> Column:
    """The parts of ``size`` characters of a text, each once; the pass is linear."""
    if size == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def gram_index(index: DataFrame) -> DataFrame:
    """``project, gram, key, rule, best``: each key under the rarest of its own grams in
    its project, of equally rare ones the smallest.

    A key of fewer than GRAM characters is its own gram. Other grams have at least half of
    their key's characters, up to LONGEST_GRAM: shorter ones are shared by ever more keys
    as a project grows. Whatever text holds a key holds its grams, so a text that is
    unfolded to its grams meets each key it holds once.
    """
    key = F.col("key")
    own, size = F.when(F.length(key) < GRAM, F.array(key)), GRAM
    while size < LONGEST_GRAM:
        own, size = own.when(F.length(key) < 2 * size, _grams(key, size)), 2 * size
    own = own.otherwise(_grams(key, LONGEST_GRAM))
    unfolded = index.filter(key.isNotNull()).select("project", "key", "rule", "best", F.explode(own).alias("gram"))
    counts = unfolded.groupBy("project", "gram").agg(F.count("*").alias("n"))
    rarest = (
        unfolded.join(counts, ["project", "gram"])
        .groupBy("project", "key", "rule")
        .agg(F.min(F.struct("n", "gram")).alias("pick"), F.min("best").alias("best"))
    )
    return rarest.select("project", F.col("pick.gram").alias("gram"), "key", "rule", "best")


def ending_index(index: DataFrame) -> DataFrame:
    """``project, gram, key, rule, best``: each key under its last characters, all of them
    or LONGEST_GRAM."""
    ending = F.right("key", F.lit(LONGEST_GRAM))
    return index.filter(F.col("key").isNotNull()).select("project", ending.alias("gram"), "key", "rule", "best")


def resolve_package(
    imports: DataFrame, nodes: DataFrame, include_root_dir: bool = False, **probe: int
) -> DataFrame:
    """``project, import, to_path`` of each distinct import some directory fits.

    A directory fits when its last name ends the import or its whole path occurs
    in it. Comparing imports with directories would pair everything within a
    project; instead last names are filed under their ends and directories under their
    rarest gram. An import is unfolded to its ends and its grams, of each length that is
    in use at most one a character, and what meets is verified. Where several fit: by
    last name first, then the longest directory, then the smallest path.
    """
    keys = stage(package_index(nodes, include_root_dir), "package-index")
    index = stage(
        ending_index(keys.filter("rule = 0")).unionByName(gram_index(keys.filter("rule = 1"))), "gram-index"
    )
    lengths = index.select("rule", F.length("gram").alias("size")).distinct().collect()
    ends, sizes = (sorted(r["size"] for r in lengths if r["rule"] == rule) for rule in (0, 1))
    text, key = F.col("import"), F.col("key")

    def under(rule: int, grams: Column) -> Column:
        return F.transform(grams, lambda g: F.struct(F.lit(rule).alias("rule"), g.alias("gram")))

    fitting = F.filter(F.array(*map(F.lit, ends)).cast("array<int>"), lambda n: n <= F.length(text))
    unfolded = (
        stage(imports.select("project", "import").distinct(), "distinct-imports")
        .select(
            "project", "import",
            F.inline(
                F.concat(under(0, F.transform(fitting, lambda n: F.right(text, n))), *[under(1, _grams(text, n)) for n in sizes])
            ),
        )
    )
    met = skew.lookup(unfolded, index, ["project", "rule", "gram"], ["project", "import"], how="inner", **probe)
    fits = F.when(F.col("rule") == 0, text.endswith(key)).otherwise(text.contains(key))
    return (
        met.filter(fits)
        .groupBy("project", "import")
        .agg(F.min(F.struct("rule", "best")).alias("pick"))
        .select("project", "import", F.col("pick.best.path").alias("to_path"))
    )


def import_edges(nodes: DataFrame, include_root_dir: bool = False, **probe: int) -> DataFrame:
    """One ``imports`` edge per resolved import, repeats and self-edges kept."""
    wanted = imports(nodes)
    relative = stage(resolve_relative(wanted, nodes, **probe), "relative-imports")
    columns = ("project", "path", "ord", "import")
    rest = (
        relative.filter(F.col("to_path").isNull())
        .select(*columns)
        .unionByName(wanted.filter(~F.col("import").startswith(".")).select(*columns))
    )
    packages = resolve_package(rest, nodes, include_root_dir, **probe)
    by_package = skew.lookup(
        rest,
        packages,
        ["project", "import"],
        ["project", "path"],
        how="inner",
        **probe,
    )
    resolved = relative.filter(F.col("to_path").isNotNull()).unionByName(
        by_package.select(*columns, "to_path")
    )
    return resolved.select(
        "project",
        paths.node_id(F.col("path")).alias("from_id"),
        paths.node_id(F.col("to_path")).alias("to_id"),
        F.lit("imports").alias("type"),
        F.col("path").alias("from_path"),
        "to_path",
        "ord",
    )


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per project, each side aggregated before the join."""
    counts = nodes.groupBy("project").agg(
        F.count("*").alias("modules"),
        F.sum(F.size(_exported_types())).cast("long").alias("types"),
        F.sum(F.size("api_routes")).cast("long").alias("api_routes"),
    )
    dependencies = edges.groupBy("project").agg(F.count("*").alias("dependencies"))
    return counts.join(dependencies, "project", "left").fillna(0, ["dependencies"])


def relationship_lines(edges: DataFrame) -> DataFrame:
    line = F.format_string("  %s --%s--> %s", "from_id", "type", "to_id")
    return edges.select("project", "from_path", "ord", line.alias("text"))


def _label(text: Column) -> Column:
    for raw, code in (('"', "#quot;"), ("<", "#lt;"), (">", "#gt;")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return F.concat(F.lit('"'), text, F.lit('"'))


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The diagram of each project as lines ordered by ``section, file, seq``.

    ``nodes`` is the node table of :func:`graph_nodes`. A project's diagram can
    be larger than any one task or row, so it is never assembled.
    """
    kind = F.col("type")

    def line(section: int, file: Column, seq: Column, text: Column) -> list[Column]:
        return [
            F.col("project"),
            F.lit(section).alias("section"),
            file.alias("file"),
            seq.cast("int").alias("seq"),
            text.alias("text"),
        ]

    label = _label(F.col("label"))
    shape = (
        F.when(kind == "type", F.concat(F.lit("{{"), label, F.lit("}}")))
        .when(kind == "api", F.concat(F.lit("(["), label, F.lit("])")))
        .when(kind == "function", F.concat(F.lit("("), label, F.lit(")")))
        .otherwise(F.concat(F.lit("["), label, F.lit("]")))
    )
    arrow = (
        F.when(kind == "calls", " -.-> ")
        .when(kind == "extends", " ==> ")
        .when(kind == "implements", " -.->|implements| ")
        .otherwise(" --> ")
    )
    pad = F.lit("    ")
    fixed = [
        (0, 0, "graph TD"),
        (2, 0, ""),
        (4, 0, ""),
        (5, 0, "    classDef module fill:#e1f5fe,stroke:#01579b"),
        (5, 1, "    classDef type fill:#f3e5f5,stroke:#4a148c"),
        (5, 2, "    classDef api fill:#e8f5e9,stroke:#1b5e20"),
    ]
    frame = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(section).alias("section"), F.lit("").alias("file"),
                    F.lit(seq).alias("seq"), F.lit(text).alias("text"),
                )
                for section, seq, text in fixed
            ]
        )
    )
    projects = nodes.select("project").distinct()
    per_node = F.array(
        F.struct(F.lit(1).alias("section"), F.concat(pad, F.col("id"), shape).alias("text")),
        F.struct(
            F.lit(6).alias("section"),
            F.when(
                kind.isin("module", "type", "api"),
                F.concat(pad, F.lit("class "), F.col("id"), F.lit(" "), kind),
            ).alias("text"),
        ),
    )
    node_lines = (
        nodes.select("project", F.col("file"), F.col("ord").alias("seq"), F.inline(per_node))
        .filter(F.col("text").isNotNull())
        .select("project", "section", "file", "seq", "text")
    )
    edge_text = F.concat(pad, F.col("from_id"), arrow, F.col("to_id"))
    edge_lines = edges.select(*line(3, F.col("from_path"), F.col("ord"), edge_text))
    return projects.select("project", frame).unionByName(node_lines).unionByName(edge_lines)


def dependency_depth(nodes: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """Files within ``depth`` imports of an entry point, with their distance.

    Each step joins the frontier only and is staged, so the plan stays flat and
    cycles end where nothing new is reached.
    """
    reached = nodes.filter(paths.report_entry_point(F.col("path"))).select(
        "project", "path", F.lit(0).alias("depth")
    )
    reached = frontier = stage(reached, "depth-0")
    links = edges.select("project", F.col("from_path").alias("path"), "to_path").distinct()
    links = stage(links, "links")
    for step in range(1, depth + 1):
        nearby = (
            frontier.select("project", "path")
            .join(links, ["project", "path"])
            .select("project", F.col("to_path").alias("path"))
            .distinct()
            .join(reached.select("project", "path"), ["project", "path"], "left_anti")
        )
        frontier = stage(nearby.withColumn("depth", F.lit(step)), f"depth-{step}")
        reached = reached.unionByName(frontier)
    return reached
