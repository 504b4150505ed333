"""SimHash near-duplicate search with BK-trees per shard.

Every text gets a fingerprint; texts whose fingerprints differ in few bits are
linked, and linked texts form groups. Fingerprints are sharded by some of their
bits, a Burkhard-Keller tree is built per shard (children keyed by their integer
Hamming distance to the parent), and look-ups follow only the edges within the
radius. A tree meets its queries by a shuffle on the shard: all trees together
grow with the corpus, so they are not broadcast. Where a similarity is given, links
of fingerprints are candidates only, and the texts' shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import GROUP_ROWS, id_and_text, map_texts
from codeloom.llm.components import components
from codeloom.llm.setlinks import links_between
from codeloom.operators.skew import lookup
from codeloom.session import stage

SEED = 42
# A shard with more fingerprints than this is cut into chunks, and each pair of
# chunks is a task of its own.
CHUNK_ROWS = 16_384
# One fingerprint in PROBE_EVERY, chosen by hash, is counted to find such shards.
PROBE_EVERY = 64
# A list of large shards, or of copies, of up to so many rows (16 bytes each) is broadcast.
BROADCAST_ROWS = 100_000
# Steps of a tree search that are held at once.
FRONTIER = 2_000_000
_HASHES = 32_768
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SimHash:
    """How texts are compared.

    ``words``: length of a shingle. ``bits``: a multiple of 64. ``radius``: the
    most bits in which linked fingerprints differ. ``tables`` is 0 for an exact
    search: the bits are cut into ``radius + 1`` blocks, and two fingerprints
    within the radius agree in a whole block. For a radius too wide for that, it
    is the number of tables, each of ``table_bits`` bits drawn once; a pair that
    differs in a share d of its bits meets with probability
    1 - (1 - (1 - d) ** table_bits) ** tables. ``similarity``: the least Jaccard of the
    sets of shingles of linked texts; 0 leaves the decision to the fingerprints.
    """

    words: int = 4
    bits: int = 64
    radius: int = 4
    tables: int = 0
    table_bits: int = 16
    similarity: float = 0.0

    def keys(self) -> list[np.ndarray]:
        """The bit positions that make up the shard key of each table."""
        if not self.tables:
            return np.array_split(np.arange(self.bits), self.radius + 1)
        draw = np.random.default_rng(SEED)
        return [
            np.sort(draw.choice(self.bits, self.table_bits, replace=False))
            for _ in range(self.tables)
        ]


# Copies with a similarity (Jaccard) of 0.8 or more on shingles of five words. Their
# sets have a cosine of 0.89 or more, so about 15 in 100 bits or fewer differ: 39 of
# 256, with a spread of 6. Unrelated texts differ in about 128. With that spread a pair
# at 0.8 lies within the radius and meets in some table with probability 0.998.
NEAR_COPIES = SimHash(words=5, bits=256, radius=64, tables=96, table_bits=14, similarity=0.8)


def shingle_hashes(text: bytes | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of the lower-cased words, in blocks."""
    found = (text or b"").lower().split()
    if not found:
        return
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(found) > words:
        starts, ends = starts[: 1 - words or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), _HASHES):
        spans = zip(starts[i : i + _HASHES].tolist(), ends[i : i + _HASHES].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def _more(hashes: np.ndarray, step: int) -> np.ndarray:
    """Further independent bits from a hash (the SplitMix64 finaliser)."""
    if not step:
        return hashes
    with np.errstate(over="ignore"):
        z = hashes + _GOLDEN * np.uint64(step)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, the highest first."""
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(octets) < 512:
        return np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    counts = [np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS for i in range(8)]
    return np.concatenate(counts)


def fingerprint(text: bytes | None, words: int, bits: int) -> bytes:
    """A bit is 1 if more than half of the shingles' hashes have it set."""
    return majority(shingle_hashes(text, words), bits)


def majority(blocks: Iterable[np.ndarray], bits: int) -> bytes:
    total, counts = 0, np.zeros(bits, np.int64)
    for hashes in blocks:
        total += len(hashes)
        for step in range(bits // 64):
            counts[64 * step : 64 * step + 64] += _bit_counts(_more(hashes, step))
    return np.packbits(2 * counts > total).tobytes()


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; of a text without words none."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def _set_name(hashes: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(hashes.tobytes(), SEED)


def fingerprints(docs: DataFrame, how: SimHash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp`` per row; a text without words (null, empty) has fingerprint zero.

    With a similarity a shingle counts once, however often it occurs, and there are
    also ``same``, a digest of the set of shingles.
    """
    if how.similarity:

        def one(text: bytes | None) -> tuple:
            own = shingle_set(text, how.words)
            return majority([own], how.bits), _set_name(own)

        return map_texts(
            id_and_text(docs, id_col, text_col),
            one,
            {"fp": "binary", "same": "binary"},
            pa.schema([("fp", pa.binary()), ("same", pa.binary())]),
        )
    return map_texts(
        id_and_text(docs, id_col, text_col),
        lambda text: (fingerprint(text, how.words, how.bits),),
        {"fp": "binary"},
        pa.schema([("fp", pa.binary())]),
    )


def _shard_rows(groups: DataFrame, how: SimHash) -> DataFrame:
    """One row per fingerprint and table: the shard is the table and its key bits."""
    keys = how.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp")
            bits = np.unpackbits(
                np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(len(fps), -1), axis=1
            )
            for table, key in enumerate(keys):
                weights = np.left_shift(np.int64(1), np.arange(len(key), dtype=np.int64))
                shard = bits[:, key].astype(np.int64) @ weights + (np.int64(table) << 40)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), batch.column("rep"), fps], names=["shard", "rep", "fp"]
                )

    return groups.mapInArrow(run, "shard long, rep long, fp binary")


def _cells(groups: DataFrame, how: SimHash) -> DataFrame:
    """Rows by cell. A large shard is cut into chunks, and each pair of its chunks
    is a cell; any other shard is one cell."""
    rows = _shard_rows(groups, how)
    probe = groups.filter(F.pmod(F.xxhash64("rep"), F.lit(PROBE_EVERY)) == 0)
    large = stage(
        _shard_rows(probe, how)
        .groupBy("shard")
        .count()
        .filter(F.col("count") * PROBE_EVERY > CHUNK_ROWS)
        .select("shard", F.ceil(F.col("count") * PROBE_EVERY / CHUNK_ROWS).cast("int").alias("m")),
        "large-shards",
    )
    found = large.count()
    if not found:
        whole = F.lit(True)
        return rows.select(
            F.col("shard").alias("cell"), whole.alias("in_tree"), whole.alias("asks"), "rep", "fp"
        )
    chunk, other = F.col("c"), F.col("o")
    return (
        rows.join(F.broadcast(large) if found <= BROADCAST_ROWS else large, "shard", "left")
        .withColumn("m", F.coalesce("m", F.lit(1)))
        .withColumn("c", F.pmod(F.xxhash64(F.lit("chunk"), "rep"), F.col("m")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select(
            F.when(F.col("m") == 1, F.col("shard"))
            .otherwise(F.xxhash64("shard", F.least(chunk, other), F.greatest(chunk, other)))
            .alias("cell"),
            (chunk >= other).alias("in_tree"),
            (chunk <= other).alias("asks"),
            "rep",
            "fp",
        )
    )


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """One BK-tree per cell, built and searched level by level for all cells at once."""

    def __init__(self, points: np.ndarray, members: np.ndarray, cells: np.ndarray, bits: int):
        """``members`` indexes ``points``; ``cells`` is the cell of each member."""
        self.points, self.span = points, bits + 1
        order = np.argsort(cells, kind="stable")
        members, cells = members[order], cells[order]
        first = np.ones(len(cells), bool)
        first[1:] = cells[1:] != cells[:-1]
        self.roots = dict(zip(cells[first].tolist(), members[first].tolist()))
        # below a root, a point descends along the child at its own distance, and
        # becomes that child where there is none
        at = members[first][np.cumsum(first) - 1] if len(members) else members
        rest, at = members[~first], at[~first]
        edges, children = [], []
        while len(rest):
            edge = at * self.span + distance(points[rest], points[at])
            order = np.argsort(edge, kind="stable")
            rest, edge = rest[order], edge[order]
            first = np.ones(len(edge), bool)
            first[1:] = edge[1:] != edge[:-1]
            edges.append(edge[first])
            children.append(rest[first])
            at = rest[first][np.cumsum(first) - 1]
            rest, at = rest[~first], at[~first]
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(edge, kind="stable")
        self.edge, self.child = edge[order], child[order]

    def search(self, asks: np.ndarray, at: np.ndarray, radius: int) -> Iterator[tuple]:
        """Pairs (asking point, tree point) within the radius, level by level."""
        while len(asks):
            apart = distance(self.points[asks], self.points[at])
            near = apart <= radius
            if near.any():
                yield asks[near], at[near]
            base = at * self.span
            low = np.searchsorted(self.edge, base + np.maximum(apart - radius, 0))
            high = np.searchsorted(self.edge, base + np.minimum(apart + radius, self.span - 1), "right")
            count = high - low
            asks = np.repeat(asks, count)
            offset = np.arange(len(asks)) - np.repeat(np.cumsum(count) - count, count)
            at = self.child[np.repeat(low, count) + offset]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of ``a`` and ``b``; the label of a set is its smallest member."""
    while True:
        x, y = label[a], label[b]
        if not (x != y).any():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _found(rows: pa.Table, how: SimHash) -> Iterator[tuple]:
    """Pairs of row numbers of one cell that lie within the radius, in blocks."""
    cell = rows.column("cell").to_numpy()
    rep = rows.column("rep").to_numpy()
    octets = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint8)
    points = octets.reshape(len(cell), -1).copy().view(">u8").astype(np.uint64)
    in_tree = np.flatnonzero(rows.column("in_tree").to_numpy(zero_copy_only=False))
    asks = np.flatnonzero(rows.column("asks").to_numpy(zero_copy_only=False))
    forest = Forest(points, in_tree, cell[in_tree], how.bits)
    cells, sizes = np.unique(cell[in_tree], return_counts=True)
    size_of = dict(zip(cells.tolist(), sizes.tolist()))
    # a chunk may have askers only; a tree of one point is asked by that point only
    asks = asks[[size_of.get(c, 0) > 0 for c in cell[asks].tolist()]]
    asks = asks[np.argsort(cell[asks], kind="stable")]
    size = np.array([size_of[c] for c in cell[asks].tolist()], np.int64)
    root = np.array([forest.roots[c] for c in cell[asks].tolist()], np.int64)
    part = np.cumsum(size) // FRONTIER
    for p in np.unique(part):
        own = part == p
        yield from forest.search(asks[own], root[own], how.radius)


def _links_of(rows: pa.Table, how: SimHash) -> pa.Table:
    rep = rows.column("rep").to_numpy()
    label = np.arange(len(rep))
    for a, b in _found(rows, how):
        label = unite(label, a, b)
    moved = np.flatnonzero(rep[label] != rep)
    return pa.table({"a": rep[moved], "b": rep[label[moved]]})


def links(groups: DataFrame, how: SimHash) -> DataFrame:
    """``a, b`` pairs of representatives that connect all fingerprints within the radius.

    ``groups(rep, fp)`` has one row per distinct fingerprint. A task yields a
    spanning forest of the links it finds, so a group of n near copies gives n - 1
    pairs per shard and not all n * n.
    """
    return _tasks(groups, how).applyInArrow(lambda rows: _links_of(rows, how), "a long, b long")


def _tasks(groups: DataFrame, how: SimHash):
    rows = groups.count() * len(how.keys())
    tasks = max(1, -(-rows // GROUP_ROWS))
    dealt = _cells(groups, how).withColumn("task", F.pmod(F.xxhash64("cell"), F.lit(tasks)))
    return dealt.select("task", "cell", "in_tree", "asks", "rep", "fp").groupBy("task")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets have a Jaccard of ``least`` or more.

    ``sets(rep, shingles)``; an identifier with several sets links by any of them, and
    two empty sets are equal.
    """
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    total = F.size("x") + F.size("y") - F.col("common")
    # one set may be the second of very many pairs, so its rows are spread
    both = lookup(pairs.join(left, "a"), right, ["b"], ["a"], how="inner")
    return (
        both.select("a", "b", "x", "y", common.alias("common"))
        .filter((total == 0) | (F.col("common") / total >= least))
        .select("a", "b")
    )


def _sets(docs: DataFrame, wanted: DataFrame, how: SimHash, id_col: str, text_col: str) -> DataFrame:
    """``rep, shingles`` of the documents in ``wanted(rep, same)``, staged."""
    few = wanted.count() <= BROADCAST_ROWS
    names = wanted.select(F.col("rep").alias("id")).distinct()
    texts = id_and_text(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    texts = texts.join(F.broadcast(names) if few else names.hint("shuffle_hash"), "id", "left_semi")

    def one(text: bytes | None) -> tuple:
        own = shingle_set(text, how.words)
        return _set_name(own), own.view(np.int64)

    schema = pa.schema([("same", pa.binary()), ("shingles", pa.list_(pa.int64()))])
    sets = map_texts(texts, one, {"same": "binary", "shingles": "array<long>"}, schema)
    # rows of one id may repeat a text, or have texts that are represented by others
    sets = sets.withColumnRenamed("id", "rep").join(wanted, ["rep", "same"], "left_semi")
    return stage(sets.groupBy("rep", "same").agg(F.any_value("shingles").alias("shingles")), "shingle-sets")


def verified(docs: DataFrame, groups: DataFrame, found: DataFrame, how: SimHash, id_col: str, text_col: str) -> DataFrame:
    """``a, b`` pairs that connect what is connected by candidates of the given similarity.

    ``found`` connects all candidates. Each member of a connected group is compared
    with its smallest first, one pair a member. Where that leaves a group in parts, the
    sets of different parts are compared in tasks that return a forest of the links they
    find: a link that fails hides none that passes, and no row is made per pair.
    """
    near = components(found, "candidate-components").withColumnRenamed("node", "rep")
    near = stage(near, "candidates")
    sets = _sets(docs, groups.join(near, "rep", "left_semi").select("rep", "same"), how, id_col, text_col)
    first = near.filter("rep != label").select(F.col("rep").alias("a"), F.col("label").alias("b"))
    first = stage(similar(first, sets.select("rep", "shingles"), how.similarity).distinct(), "similar-to-first")
    # its links all lead to the smallest of a group, so they are the components
    comp = near.join(first.select(F.col("a").alias("rep"), F.col("b").alias("first")), "rep", "left").select(
        "rep", "label", F.coalesce("first", "rep").alias("comp")
    )
    parted = comp.groupBy("label").agg(F.count("*").alias("n"), F.min("comp").alias("f"), F.max("comp").alias("g"))
    open_ = comp.join(parted.filter("f != g and n > 2").select("label"), "label", "left_semi")
    left = stage(open_.select("rep", "label", "comp"), "parted-groups")
    if left.isEmpty():
        return first
    members = stage(left.join(sets, "rep"), "parted-sets")
    return first.unionByName(links_between(members, how.similarity))


def near_duplicates(docs: DataFrame, how: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, component_id`` per row: the smallest id that links reach, itself included.

    Null and empty texts have fingerprint zero and link like any other. Rows of
    one id count as one document if their texts agree, and link its texts if not.
    A row with a null id joins the group of its fingerprint, but names none: its
    ``component_id`` is null where no other id is in reach. Exact copies share a
    fingerprint and are searched once. With a similarity, texts of one set of shingles
    are searched once, and only links of that similarity count.
    """
    own = stage(fingerprints(docs, how, id_col, text_col), "fingerprints")
    key = "same" if how.similarity else "fp"
    more = [F.any_value("fp").alias("fp")] if how.similarity else []
    groups = stage(
        own.groupBy(key).agg(F.min("id").cast("long").alias("rep"), *more).filter("rep is not null"),
        "fingerprint-groups",
    )
    found = stage(links(groups, how), "fingerprint-links")
    if how.similarity:
        found = stage(verified(docs, groups, found, how, id_col, text_col), "similar-pairs")
    # texts that share an id are one document
    shared = own.groupBy("id").agg(F.min(key).alias("f"), F.max(key).alias("g")).filter("f != g")
    several = own.join(shared.select("id"), "id").select("id", key).join(groups, key)
    found = found.unionByName(several.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    label = components(found, "fingerprint-components").withColumnRenamed("node", "rep")
    named = groups.join(label, "rep", "left").select(
        key, F.coalesce("label", "rep").alias("component_id")
    )
    return own.join(named, key, "left").select("id", "fp", "component_id")


def keep_one_each(docs: DataFrame, how: SimHash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have the smallest id of their group, columns as they are.

    Of rows that share an id one stays, that with the smallest text. Rows with a null
    id are in no group and stay. The list of what goes is joined to ``docs``: broadcast
    up to ``BROADCAST_ROWS`` ids, so that no text is shuffled, and beyond that by a
    hash join on the id.
    """
    found = stage(near_duplicates(docs, how, id_col, text_col), "near-duplicates")
    gone = stage(
        found.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias(id_col)).distinct(),
        "copies",
    )
    few = gone.count() <= BROADCAST_ROWS
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), id_col, "left_anti").select(names)
    repeated = stage(
        found.filter("id = component_id").groupBy("id").count().filter("count > 1")
        .select(F.col("id").alias(id_col)),
        "repeated-ids",
    )
    if repeated.isEmpty():
        return kept
    single = (
        kept.join(repeated, id_col, "left_semi")
        .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*names).alias("row"))
        .groupBy("id")
        .agg(F.min_by("row", F.struct("text", F.xxhash64(F.to_json("row")))).alias("row"))
        .select("row.*")
    )
    return kept.join(repeated, id_col, "left_anti").select(names).unionByName(single)
