"""Sharding through fixed virtual slots, DataFrame functions only.

A record's hash gives one of some thousands of slots, for good. Slots lie on shards
by a small versioned map, and only the map is edited when shards are added or their
sizes drift: whole slots move, and a record is never hashed anew.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import new_stage_path, stage

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """``shard_of[slot]``; a version never changes, an edit makes the next one."""

    version: int
    shards: int
    shard_of: list[int] = field(repr=False)

    @classmethod
    def even(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, [slot % shards for slot in range(slots)])

    def loads(self, sizes: list[int]) -> list[int]:
        total = [0] * self.shards
        for slot, shard in enumerate(self.shard_of):
            total[shard] += sizes[slot]
        return total

    def rebalanced(self, sizes: list[int], shards: int | None = None) -> SlotMap:
        """The next version, in which slots have moved off the heaviest shards until no
        move of a slot brings the heaviest and the lightest closer.

        ``shards`` may be larger than before: new shards start empty. Each step
        moves one slot, that whose size is nearest to half of the gap.
        """
        shards = self.shards if shards is None else shards
        if shards < self.shards:
            raise ValueError("shards can be added only")
        shard_of = list(self.shard_of)
        on: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        for slot, shard in enumerate(shard_of):
            if sizes[slot]:
                insort(on[shard], (sizes[slot], slot))
        load = [sum(size for size, _ in own) for own in on]
        while True:
            high = max(range(shards), key=lambda s: (load[s], -s))
            low = min(range(shards), key=lambda s: (load[s], s))
            gap = load[high] - load[low]
            at = bisect_left(on[high], (gap / 2, -1))
            near = [on[high][i] for i in (at - 1, at) if 0 <= i < len(on[high])]
            near = [x for x in near if x[0] < gap]
            # the rest of the way, under a hundredth of a per mille, is not worth moves
            if not near or gap * shards <= sum(load) // 100_000:
                return SlotMap(self.version + 1, shards, shard_of)
            size, slot = min(near, key=lambda x: (abs(x[0] - gap / 2), x[1]))
            on[high].remove((size, slot))
            insort(on[low], (size, slot))
            load[high] -= size
            load[low] += size
            shard_of[slot] = low

    def grown(self) -> SlotMap:
        """The next version with one more shard, which takes its share of slots from
        all others; no slot moves between old shards."""
        shards, shard_of = self.shards + 1, list(self.shard_of)
        own: list[list[int]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(shard_of):
            own[shard].append(slot)
        for _ in range(len(shard_of) // shards):
            giver = max(range(self.shards), key=lambda s: (len(own[s]), -s))
            shard_of[own[giver].pop()] = self.shards
        return SlotMap(self.version + 1, shards, shard_of)


def by_slot(values: list[int], slot: Column) -> Column:
    """``values[slot]``: the list, one number per slot, is a constant of the plan."""
    constant = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    return F.element_at(constant, (slot + 1).cast("int"))


def slotted(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, vslot`` per row.

    A row's size is its text in UTF-8 plus 1; a null text has no bytes. The hash is
    of id and text, so rows that share an id, or have none, are spread as well.
    """
    octets = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(octets) + 1).cast("long").alias("size"),
        F.crc32(octets).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), octets), F.lit(slots)).cast("int").alias("vslot"),
    )


def usage(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows per slot: two numbers for each of the fixed slots."""
    sizes, counts = [0] * slots, [0] * slots
    grouped = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    for row in grouped.collect():
        sizes[row["vslot"]], counts[row["vslot"]] = row["bytes"], row["n"]
    return sizes, counts


def save(spark, slot_map: SlotMap, sizes: list[int], root: str) -> None:
    """Writes ``vslot, shard, bytes`` of a version to a folder of its own."""
    slot = F.col("vslot")
    spark.range(len(slot_map.shard_of), numPartitions=1).select(
        F.col("id").cast("int").alias("vslot")
    ).select(
        slot, by_slot(slot_map.shard_of, slot).cast("int").alias("shard"), by_slot(sizes, slot).alias("bytes")
    ).write.parquet(f"{root}/version={slot_map.version}")


def load(spark, root: str, version: int) -> SlotMap:
    rows = sorted(spark.read.parquet(f"{root}/version={version}").select("vslot", "shard").collect())
    shard_of = [row["shard"] for row in rows]
    return SlotMap(version, max(shard_of) + 1, shard_of)


def placed(rows: DataFrame, slot_map: SlotMap, counts: list[int]) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, their place in the shard, gapless from 0.

    A place is the number of rows in the shard's earlier virtual slots plus the
    place in the own one, so rows are numbered per virtual slot and never per shard.
    """
    start, before = [], [0] * slot_map.shards
    for vslot, shard in enumerate(slot_map.shard_of):
        start.append(before[shard])
        before[shard] += counts[vslot]
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "size", "text_crc32"))
    return rows.withColumn("shard", by_slot(slot_map.shard_of, F.col("vslot")).cast("int")).withColumn(
        "slot", by_slot(start, F.col("vslot")) + place - 1
    )


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, vslot, shard, slot`` per row, shards near equal in bytes.

    The even map is version 1; version 2 is edited by the bytes of each slot, and
    both are stored. Two passes over four narrow columns; one shuffle, by slot.
    """
    rows = stage(slotted(docs, slots, id_col, text_col), "slotted")
    sizes, counts = usage(rows, slots)
    first = SlotMap.even(shards, slots)
    second = first.rebalanced(sizes)
    root = new_stage_path(docs.sparkSession, "slot-map")
    for slot_map in (first, second):
        save(docs.sparkSession, slot_map, sizes, root)
    return placed(rows, load(docs.sparkSession, root, second.version), counts)
