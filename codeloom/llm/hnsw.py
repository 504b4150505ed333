"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Vectors of one label are cut into shards of bounded size, and each shard gets a
graph. Every shard is queried with the vectors of every shard of its label; a pair of
shards is one task, which looks both ways. A beam that misses pairs which brute force
finds for an audit sample is widened until the audit passes, or until it would cost as
much as comparing all; found pairs are verified in double precision, and linked vectors
form components.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.components import components
from codeloom.llm.simhash import unite
from codeloom.session import stage

THRESHOLD = 0.93
SHARD_ROWS = 8192
SHARD_BYTES = 8 << 20  # of float32 components; wide vectors get smaller shards
LINKS = 16  # neighbours that a new vector gets; twice as many are kept
BUILD_BEAM = 64
BEAM = 48
AUDIT_ROWS = 1024
AUDIT_RECALL = 0.995
BATCH = 512
# Single precision orders the search; only double precision decides.
_SLACK = 1e-4


@dataclass
class Graph:
    """``layers[0]`` holds all vectors, each further one about 1 in LINKS of the last."""

    unit: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]  # members, neighbours (both node numbers)


def _beam(unit: np.ndarray, near: np.ndarray, asks: np.ndarray, entry: np.ndarray, width: int) -> tuple:
    """Best-first search of all rows of ``asks`` at once, from the nodes in ``entry``.

    ``near[node]`` lists neighbours, padded by -1. Gives nodes (-1: none) and their
    similarities, unordered, ``width`` per row.
    """
    rows = np.arange(len(asks))
    seen = np.zeros((len(asks), len(unit) + 1), bool)
    seen[:, -1] = True  # the padding
    node = np.full((len(asks), width), -1, np.int64)
    close = np.full((len(asks), width), -np.inf, np.float32)
    done = np.ones((len(asks), width), bool)
    found, there = entry, np.einsum("qmd,qd->qm", unit[entry], asks)
    there = np.where(np.take_along_axis(seen, entry, axis=1), -np.inf, there)
    while True:
        seen[rows[:, None], found] = True
        node = np.concatenate([node, np.where(np.isneginf(there), -1, found)], axis=1)
        close = np.concatenate([close, there], axis=1)
        done = np.concatenate([done, np.isneginf(there)], axis=1)
        best = np.argpartition(-close, width - 1, axis=1)[:, :width]
        node, close, done = (np.take_along_axis(x, best, axis=1) for x in (node, close, done))
        open_ = np.where(done, -np.inf, close)
        pick = open_.argmax(axis=1)
        more = open_[rows, pick] > -np.inf
        if not more.any():
            return node, close
        done[rows, pick] = True
        found = np.where(more[:, None], near[node[rows, pick]], -1)
        fresh = ~np.take_along_axis(seen, found, axis=1)
        # only what is new is compared
        q, m = np.nonzero(fresh)
        there = np.full(found.shape, -np.inf, np.float32)
        there[q, m] = np.einsum("nd,nd->n", unit[found[q, m]], asks[q])


def _diverse(unit: np.ndarray, nodes: np.ndarray, close: np.ndarray, keep: int) -> np.ndarray:
    """The neighbours of each row: a candidate nearer to a chosen one than to the row
    itself comes last, so that groups of copies stay connected to the rest."""
    order = np.argsort(-close, axis=1, kind="stable")
    nodes, close = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(close, order, axis=1)
    points = unit[nodes]
    among = np.einsum("qad,qbd->qab", points, points)
    nearest = np.full(close.shape, -np.inf, np.float32)
    count, rank = np.zeros(len(nodes), np.int64), np.full(close.shape, 2, np.int64)
    rank[np.isneginf(close)] = 3
    for c in range(nodes.shape[1]):
        take = (count < keep) & (nearest[:, c] < close[:, c]) & (rank[:, c] < 3)
        rank[take, c] = 1
        count += take
        nearest = np.where(take[:, None], np.maximum(nearest, among[:, c]), nearest)
    order = np.argsort(rank, axis=1, kind="stable")[:, :keep]
    chosen = np.where(np.take_along_axis(rank, order, axis=1) < 3, np.take_along_axis(nodes, order, axis=1), -1)
    if chosen.shape[1] < keep:
        chosen = np.pad(chosen, ((0, 0), (0, keep - chosen.shape[1])), constant_values=-1)
    return chosen


def _layer(unit: np.ndarray, members: np.ndarray, upper: Graph | None) -> np.ndarray:
    """Links ``members``, batch by batch, each batch searching those before it."""
    room = 2 * LINKS
    near = np.full((len(unit) + 1, room), -1, np.int64)  # the last row is the padding's
    ready = members[: room + 1]
    for node in ready:
        others = ready[ready != node]
        near[node, : len(others)] = others
    at = len(ready)
    while at < len(members):
        new = members[at : at + min(BATCH, at)]
        at += len(new)
        asks = unit[new]
        entry = _entries(upper, asks) if upper else np.full((len(new), 1), members[0])
        node, close = _beam(unit, near, asks, entry, BUILD_BEAM)
        same = asks @ asks.T
        np.fill_diagonal(same, -np.inf)
        few = min(LINKS, len(new) - 1)
        if few > 0:
            beside = np.argpartition(-same, few - 1, axis=1)[:, :few]
            node = np.concatenate([node, new[beside]], axis=1)
            close = np.concatenate([close, np.take_along_axis(same, beside, axis=1)], axis=1)
        chosen = _diverse(unit, np.where(node < 0, 0, node), close, LINKS)
        near[new, :LINKS] = chosen
        # the way back: a node with no room left chooses among old and new neighbours
        back, source = chosen.ravel(), np.repeat(new, LINKS)
        back, source = back[back >= 0], source[back >= 0]
        order = np.argsort(back, kind="stable")
        back, source = back[order], source[order]
        target, first, count = np.unique(back, return_index=True, return_counts=True)
        wide = int(count.max()) if len(count) else 0
        extra = np.full((len(target), wide), -1, np.int64)
        extra[np.repeat(np.arange(len(target)), count), np.arange(len(back)) - np.repeat(first, count)] = source
        both = np.concatenate([near[target], extra], axis=1)
        # a link may exist already, in a batch that chose each other
        ordered = np.sort(both, axis=1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        for i in range(0, len(target), BATCH):
            part = ordered[i : i + BATCH]
            close = np.einsum("qmd,qd->qm", unit[part], unit[target[i : i + BATCH]])
            close = np.where(part < 0, -np.inf, close).astype(np.float32)
            near[target[i : i + BATCH]] = _diverse(unit, np.where(part < 0, 0, part), close, room)
    return near


def _entries(graph: Graph, asks: np.ndarray) -> np.ndarray:
    """Where to enter the layer below ``graph``, by descending through its layers."""
    top = graph.layers[-1][0]
    entry = np.full((len(asks), 1), top[0])
    for _, near in reversed(graph.layers):
        node, close = _beam(graph.unit, near, asks, entry, 4)
        entry = np.take_along_axis(node, close.argmax(axis=1)[:, None], axis=1)
    return entry


def build(unit: np.ndarray, seed: int = 5) -> Graph:
    """The graph of a shard; the same vectors give the same graph."""
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(unit))
    height = np.floor(-np.log(1 - draw.random(len(unit))) / np.log(LINKS)).astype(np.int64)
    upper = Graph(unit, [])
    for level in range(int(height.max(initial=0)), -1, -1):
        members = order[height[order] >= level]
        near = _layer(unit, members, upper if upper.layers else None)
        upper.layers.insert(0, (members, near))
    return upper


def dear(width: int, size: int) -> bool:
    """Whether a beam costs a row as many comparisons as all vectors of the shard do.

    A beam takes about ``width`` steps, each to a node of 2 * LINKS neighbours; the
    other way is ``size`` comparisons, in one product.
    """
    return width * 2 * LINKS >= size


def _exactly(graph: Graph, asks: np.ndarray, least: float) -> Iterator[tuple]:
    for i in range(0, len(asks), BATCH):
        row, node = np.nonzero(asks[i : i + BATCH] @ graph.unit.T >= least)
        yield row + i, node


def search(
    graph: Graph, asks: np.ndarray, least: float, width: int, own: np.ndarray | bool = False
) -> Iterator[tuple]:
    """Pairs (rows of ``asks``, nodes) of a similarity of ``least`` or more, in blocks.

    A row whose whole beam is that near is asked again with a beam four times as wide,
    or compared with all vectors where that is no dearer. ``own``: the node that each row
    is, as an entry for itself; True where row and node numbers are the same.
    """
    size = len(graph.unit)
    pending = np.arange(len(asks))
    nodes = pending if own is True else own
    upper = Graph(graph.unit, graph.layers[1:])
    while len(pending) and not dear(width, size):
        again = []
        rows = max(16, min(BATCH, (8 << 20) // (size + 64 * width)))
        for i in range(0, len(pending), rows):
            part = pending[i : i + rows]
            entry = _entries(upper, asks[part]) if upper.layers else np.full((len(part), 1), graph.layers[0][0][0])
            if own is not False:
                # a node that is found as its own entry must not be in the beam twice
                self_ = nodes[part][:, None]
                entry = np.concatenate([self_, np.where(entry == self_, -1, entry)], axis=1)
            node, close = _beam(graph.unit, graph.layers[0][1], asks[part], entry, width)
            near = close >= least
            full = near.all(axis=1)
            again.append(part[full])
            q, m = np.nonzero(near & ~full[:, None])
            yield part[q], node[q, m]
        pending = np.concatenate(again)
        width *= 4
    for row, node in _exactly(graph, asks[pending], least):
        yield pending[row], node


def audited(graph: Graph, asks: np.ndarray, least: float, own: bool = False) -> np.ndarray:
    """``search`` as a matrix (row of ``asks``, node), with a beam wide enough that, of up
    to AUDIT_ROWS rows that link to anything, AUDIT_RECALL find all that brute force finds.

    Only the audited rows are searched until a beam passes; then all rows are, once. Where
    beams get too dear before one passes, all rows are compared with all vectors instead.
    Rows count, not links, so that a large group does not hide small ones. Rows of so
    many links that their beams overflow are compared with all and say nothing about a
    beam, so they count only where they miss something. A link to itself is none.
    """
    size = len(graph.unit)
    sample = np.linspace(0, len(asks) - 1, min(AUDIT_ROWS, len(asks))).astype(np.int64)
    width, passed = BEAM, False
    found = np.zeros((len(asks), size), bool)
    if not dear(width, size):
        truth = asks[sample] @ graph.unit.T >= least
        if own:
            truth[np.arange(len(sample)), sample] = False
        links = truth.sum(axis=1)
    while not passed and not dear(width, size):
        tried = np.zeros((len(sample), size), bool)
        for row, node in search(graph, asks[sample], least, width, sample if own else False):
            tried[row, node] = True
        whole = ~(truth & ~tried).any(axis=1)
        counts = (links > 0) & ~(whole & (links >= width))
        passed = (whole & counts).sum() >= AUDIT_RECALL * counts.sum()
        if not passed:
            width *= 2
    for row, node in search(graph, asks, least, width, own) if passed else _exactly(graph, asks, least):
        found[row, node] = True
    return found


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    # components far from 1 must not overflow when squared
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _pack(rows: pa.Table) -> pa.Table:
    """A shard's vectors and graph as one row."""
    rows = rows.sort_by("rep")
    vectors = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors = vectors.astype(np.float64).reshape(len(rows), -1)
    unit = _unit(vectors)
    layers = [(m.astype(np.int32), n.astype(np.int32)) for m, n in build(unit.astype(np.float32)).layers]
    packed = pickle.dumps(
        (rows.column("rep").to_numpy(), rows.column("copies").to_numpy(), unit, layers), protocol=5
    )
    first = {n: rows.column(n)[0].as_py() for n in ("space", "shard", "shards")}
    return pa.table({**{n: pa.array([v], pa.int64()) for n, v in first.items()}, "graph": pa.array([packed], pa.binary())})


def _match(rows: pa.Table, threshold: float) -> pa.Table:
    """Links between two shards, or within one: per vector the number of vectors it
    links to and a root of its local component. Pairs are bits of a matrix of the two
    shards, and are gone through in blocks of its rows."""
    sides = [pickle.loads(x) for x in rows.sort_by("shard").column("graph").to_pylist()]
    graphs = [
        Graph(unit.astype(np.float32), [(m.astype(np.int64), n.astype(np.int64)) for m, n in layers])
        for _, _, unit, layers in sides
    ]
    (rep, copies, unit, _), (other, other_copies, other_unit, _) = sides[0], sides[-1]
    least, one = threshold - _SLACK, len(sides) == 1
    found = audited(graphs[0], graphs[-1].unit, least, own=one).T.copy()
    found |= audited(graphs[-1], graphs[0].unit, least, own=one) if not one else found.T.copy()
    shift = 0 if one else len(rep)
    label = np.arange(shift + len(other))
    n = np.zeros(len(label), np.int64)
    for i in range(0, len(rep), BATCH):
        a, b = np.nonzero(found[i : i + BATCH])
        a += i
        if one:
            a, b = a[a < b], b[a < b]
        if len(a) > 16 * BATCH:  # dense: all of the block at once
            exact = (unit[i : i + BATCH] @ other_unit.T)[a - i, b] >= threshold
        else:
            exact = np.einsum("nd,nd->n", unit[a], other_unit[b]) >= threshold
        a, b = a[exact], b[exact]
        n += np.bincount(a, other_copies[b], len(n)).astype(np.int64)
        n += np.bincount(b + shift, copies[a], len(n)).astype(np.int64)
        label = unite(label, a, b + shift)
    names = rep if one else np.concatenate([rep, other])
    linked = np.flatnonzero(n)
    return pa.table({"rep": names[linked], "n": n[linked], "root": names[label[linked]]})


def _valid(vector, label):
    """Usable vectors: not null, not zero, every component a finite number."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    )
    return F.coalesce(
        label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id",
    vector_col: str = "embedding", label_col: str = "label", shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``id, n_links, component_id, kept`` per row.

    Vectors are compared where labels and lengths are equal. Those without a label,
    null or zero, or with a null or non-finite component link with nothing. Equal
    vectors are one node with a number of copies, which link each other. Rows that
    repeat an id are vectors of their own; a row with a null id joins its copies.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = stage(
        embeddings.select(
            F.col(id_col).cast("long").alias("id"),
            _valid(vector, F.col(label_col)).alias("valid"),
            F.xxhash64(F.col(label_col).cast("string"), F.size(vector)).alias("space"),
            F.xxhash64(F.col(label_col).cast("string"), vector).alias("k1"),
            F.xxhash64(F.lit("copy"), vector, F.col(label_col).cast("string")).alias("k2"),
            vector.alias("vector"),
        ),
        "embeddings",
    )
    groups = stage(
        rows.filter("valid").groupBy("space", "k1", "k2")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
        .filter("rep is not null"),
        "embedding-groups",
    )
    per_shard = F.greatest(
        F.lit(64), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (4 * F.max(F.size("vector")))))
    )
    sizes = groups.groupBy("space").agg(F.ceil(F.count("*") / per_shard).cast("long").alias("shards"))
    dealt = groups.join(sizes, "space").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")))
    graphs = stage(
        dealt.select("space", "shard", "shards", "rep", "copies", "vector")
        .groupBy("space", "shard")
        .applyInArrow(_pack, "space long, shard long, shards long, graph binary"),
        "embedding-graphs",
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    found = stage(
        graphs.withColumn("other", other)
        .select("space", F.least("shard", "other").alias("i"), F.greatest("shard", "other").alias("j"), "shard", "graph")
        .groupBy("space", "i", "j")
        .applyInArrow(lambda t: _match(t, threshold), "rep long, n long, root long"),
        "embedding-links",
    )
    label = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "embedding-components")
    counted = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = (
        groups.select("k1", "k2", "rep", "copies")
        .join(counted, "rep", "left")
        .join(label.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
            F.coalesce("label", "rep").alias("component"), F.lit(True).alias("valid"),
        )
    )
    return rows.drop("vector", "space").join(named, ["k1", "k2", "valid"], "left").select(
        "id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce("component", "id").eqNullSafe(F.col("id")).alias("kept"),
    )
