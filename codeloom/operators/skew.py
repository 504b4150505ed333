"""Look-ups that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import stage

# One row in PROBE_EVERY is looked at to find hot keys. A key that holds more of those
# than a shuffle partition does on average is split over its share of the partitions. So
# there are at most as many hot keys as shuffle partitions, and at most twice as many
# parts of them, whatever the size of the data.
PROBE_EVERY = 100

# Rows of a table that goes to every task, as long as it has no more.
BROADCAST_ROWS = 20_000


def hot_keys(keyed: DataFrame, partitions: int, probe_every: int = PROBE_EVERY) -> DataFrame:
    """``_key, _parts`` of the keys that hold more rows than a partition does on average:
    a key with a third of the rows gets a third of the partitions.

    ``keyed(_key, _row)``: a hash of the key and one of the row, which decides whether
    a row is looked at. The counts are written, as several plans read them.
    """
    counts = stage(
        keyed.filter(F.pmod("_row", F.lit(probe_every)) == 0).groupBy("_key").count(), "probe"
    )
    average = (counts.agg(F.sum("count")).first()[0] or 0) / partitions
    parts = F.ceil(F.col("count") / F.lit(max(average, 1e-9))).cast("int")
    return counts.filter(F.col("count") > average).select("_key", parts.alias("_parts"))


def attach(left: DataFrame, right: DataFrame, keys: list[str], row_id: list[str], how: str = "left") -> DataFrame:
    """:func:`lookup` of a table that is dear to compute or small. It is staged and counted:
    up to BROADCAST_ROWS rows go to every task, and the left rows are not shuffled."""
    right = stage(right, "attached")
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), keys, how)
    return lookup(left, right, keys, row_id, how)


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    row_id: list[str],
    how: str = "left",
    probe_every: int = PROBE_EVERY,
    partitions: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right``, which has one or few rows per key.

    Hot keys of ``left`` are found from a hash-chosen share of its rows. That
    choice only decides the salting: every row is joined. The hot list has at
    most as many rows of twelve bytes as there are shuffle partitions, so it can
    always be broadcast; the rows of ``right`` are repeated for those keys only.

    The probe is a job of its own, which runs while the query is built, and reads
    ``left``: stage an input that is dear to compute. ``row_id`` spreads the left rows
    of one key. Columns that exist before a row is unfolded serve best: the probe's
    filter then moves below the unfolding. All inputs must be deterministic.
    ``partitions`` is taken from the session's shuffles unless given.
    """
    hashed = left.withColumn("_key", F.xxhash64(*keys)).withColumn(
        "_row", F.xxhash64(F.lit("row"), *row_id)
    )
    if partitions is None:
        partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(hashed.select("_key", "_row"), partitions, probe_every))
    parts, none = F.coalesce("_parts", F.lit(1)), F.lit(0)
    salted = (
        hashed.join(hot, "_key", "left")
        .withColumn("_salt", F.pmod(F.shiftright("_row", 7), parts).cast("int"))
        .drop("_key", "_row", "_parts")
    )
    repeated = (
        right.withColumn("_key", F.xxhash64(*keys))
        .join(hot, "_key", "left")
        .withColumn("_salt", F.explode(F.sequence(none, parts - 1)))
        .drop("_key", "_parts")
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
