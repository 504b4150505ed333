"""Links between the similar sets of large groups, without a row per pair.

Two sets of a Jaccard of t or more share a token among the first
``size - ceil(t * size) + 1`` of each, in any order that both follow. Tokens are
ordered by how few sets of their group hold them, so most cells (the sets of a group
that have a token among their first ones) are small, and those whose sets are united
already are dropped. Cells meet their sets in tasks of bounded size, which compare what
is not united yet and return a spanning forest of the links found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.skew import lookup
from codeloom.session import stage

# Bytes of sets that a task is dealt, and those of one cell before it is cut into chunks
# of which each pair is a cell of its own.
TASK_BYTES = 16 << 20
CELL_BYTES = 4 << 20
# Tokens that are compared at once.
BLOCK_TOKENS = 2_000_000


def _prefixes(members: DataFrame, least: float) -> DataFrame:
    """``label, token, same, rep, comp, size`` of the rarest tokens of each set, of those
    tokens that sets of different parts of the group hold."""
    tokens = members.select("label", "comp", "rep", "same", F.explode("shingles").alias("token"))
    counts = stage(
        tokens.groupBy("label", "token")
        .agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")),
        "token-counts",
    )
    counted = lookup(tokens, counts, ["label", "token"], ["same"], how="inner")
    size = F.size("own")
    length = size - F.ceil(F.lit(least) * size - F.lit(1e-9)).cast("int") + 1
    own = counted.groupBy("label", "same", "rep", "comp").agg(
        F.array_sort(F.collect_list(F.struct("n", "token", (F.col("low") != F.col("high")).alias("open")))).alias("own")
    )
    return own.select(
        "label", "same", "rep", "comp", size.cast("long").alias("size"), F.inline(F.slice("own", F.lit(1), length))
    ).filter("open").select("label", "token", "same", "rep", "comp", "size")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``cell`` and ``task``: cells of one group share tasks as far as
    those have room, so that a set travels to few of them."""
    octets = (F.sum("size") * 8).alias("octets")
    cells = rows.groupBy("label", "token").agg(octets, F.min("comp").alias("low"), F.max("comp").alias("high"))
    cells = stage(cells.filter("low != high").drop("low", "high"), "set-cells")
    whole = cells.agg(F.sum("octets")).first()[0] or 0
    tasks = max(1, -(-whole // TASK_BYTES))
    groups = cells.groupBy("label").agg(F.ceil(F.sum("octets") / TASK_BYTES).alias("parts"))
    sized = lookup(cells, groups, ["label"], ["token"], how="inner").select(
        "label", "token", F.ceil(F.col("octets") / CELL_BYTES).alias("chunks"), "parts"
    )
    chunk, other = F.col("chunk"), F.col("other")
    part = F.pmod(F.xxhash64("token", "low", "high"), F.col("parts"))
    return (
        lookup(rows, stage(sized, "sized-cells"), ["label", "token"], ["same"], how="inner")
        .withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "same"), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .withColumn("low", F.least(chunk, other))
        .withColumn("high", F.greatest(chunk, other))
        .select(
            F.pmod(F.xxhash64("label", part), F.lit(tasks)).alias("task"),
            F.xxhash64("label", "token", "low", "high").alias("cell"),
            "same", "rep", "comp",
        )
    )


def _forest(rows: pa.Table, sets: pa.Table, least: float) -> Iterator[tuple[int, int]]:
    """Links (representatives) that unite what similar sets of common cells unite."""
    names, own = np.unique(np.array(sets.column("name").to_pylist(), object), return_index=True)
    place = {name: i for i, name in enumerate(names.tolist())}
    lists = sets.column("shingles").combine_chunks()
    tokens = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    starts = lists.offsets.to_numpy()
    starts = starts - starts[0]
    starts, sizes = starts[:-1][own], np.diff(starts)[own]
    at = np.array([place[s] for s in rows.column("same").to_pylist()], np.int64)
    rep, comp = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    rep[at] = rows.column("rep").to_numpy()
    # parts are numbered, and united by pointing at each other
    parts, comp[at] = np.unique(rows.column("comp").to_numpy(), return_inverse=True)
    root = np.arange(len(parts))
    cell = np.unique(rows.column("cell").to_numpy(), return_inverse=True)[1]
    pairs = np.unique(np.stack([cell, at]), axis=1)
    cell, member = pairs
    first = np.searchsorted(cell, np.arange(cell.max(initial=-1) + 2))
    cells_of = np.split(cell[np.argsort(member, kind="stable")], np.cumsum(np.bincount(member, minlength=len(names)))[:-1])
    marked = np.zeros(tokens.max(initial=-1) + 1, bool)
    for x in range(len(names)):
        others = [member[first[c] : first[c + 1]] for c in cells_of[x]]
        others = np.unique(np.concatenate([o[o < x] for o in others])) if others else np.zeros(0, np.int64)
        smaller, larger = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
        others = others[(smaller >= least * larger - 1e-6) & (root[comp[others]] != root[comp[x]])]
        if not len(others):
            continue
        marked[tokens[starts[x] : starts[x] + sizes[x]]] = True
        block = np.cumsum(sizes[others]) // BLOCK_TOKENS
        for b in np.unique(block):
            some = others[block == b]
            offsets = np.cumsum(sizes[some]) - sizes[some]
            index = np.arange(sizes[some].sum()) + np.repeat(starts[some] - offsets, sizes[some])
            common = np.add.reduceat(marked[tokens[index]].astype(np.int64), offsets)
            total = sizes[some] + sizes[x] - common
            for y in some[common >= least * total - 1e-9].tolist():
                a, b_ = root[comp[x]], root[comp[y]]
                if a != b_:
                    root[root == max(a, b_)] = min(a, b_)
                    yield int(rep[x]), int(rep[y])
        marked[tokens[starts[x] : starts[x] + sizes[x]]] = False


def links_between(members: DataFrame, least: float) -> DataFrame:
    """``a, b`` (representatives) that connect the parts ``comp`` of each group ``label``
    wherever sets of two parts have a Jaccard of ``least`` or more.

    ``members(label, comp, rep, same, shingles)``: a row per set, named by ``same``, of
    distinct hashes. Sets without tokens link with nothing. A task returns at most as
    many links as there are parts in it, less one.
    """
    rows = stage(_dealt(stage(_prefixes(members, least), "set-prefixes")), "dealt-cells")
    named = members.select("same", "shingles")
    sets = rows.select(F.col("task").alias("of"), "same").distinct().join(named, "same")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_forest(left, right, least)) if len(left) and len(right) else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return (
        rows.groupBy("task").cogroup(sets.select("of", F.col("same").alias("name"), "shingles").groupBy("of"))
        .applyInArrow(run, "a long, b long")
    )
