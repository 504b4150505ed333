"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import stage

MAX_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node in its reach."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return moved.unionByName(least.withColumnRenamed("m", "v"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, label`` for each node of ``links(a, b)``; the label is the smallest
    node that links reach.

    Each round is two joins on node and leaves at most as many edges as there
    are nodes; it is written to the shared folder, so a lost executor costs one
    round and plans stay flat. Minima are combined before each shuffle, and the
    edges of a node with very many links are split by AQE's skew join. Links
    with a null end are ignored, a link of a node to itself as well.
    """
    oriented = links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = stage(oriented.distinct(), name)
    before = _signature(edges)
    if before[0]:
        for _ in range(MAX_ROUNDS):
            edges = stage(_small_star(_large_star(edges).distinct()).distinct(), name)
            after = _signature(edges)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    # at the fixed point every edge leads from a node to its label
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
