"""Keep extracted files current while new file versions arrive."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.config import AnalysisConfig
from codeloom.operators import extract, scan
from codeloom.session import COMPRESSION, stage_at
from codeloom.sources.snapshot import SnapshotStore

VERSION_SCHEMA = "project string, path string, seq long, content string"
KEYS = ["project", "path"]
KEPT = ("seq", "deleted", "digest")
# The log is folded into the state after so many batches.
COMPACT_EVERY = 16
# Parts of the state, by a hash of project and path; a fold rewrites those with arrivals.
BUCKETS = 32


class WatchStore:
    """A log of extracted batches beside a state in buckets; the current state is the
    newest row per file.

    A batch only ever writes its own folder, so replaying it changes nothing,
    and a version that arrives late cannot displace a newer one: it is left out of its
    batch before its text is read for symbols. A fold writes the
    buckets that its batches touch anew, commits which folder holds which bucket, and then
    deletes what the fold before it has superseded: what a reader of the last but one
    state may still read stays until the next fold.
    """

    def __init__(
        self, spark: SparkSession, root: str, config: AnalysisConfig = AnalysisConfig(), buckets: int = BUCKETS
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.config = config
        self.buckets = buckets
        self.base = SnapshotStore(spark, f"{self.root}/base")

    def _extracted(self, accepted: DataFrame) -> DataFrame:
        versions = accepted.withColumn("deleted", F.col("content").isNull() | extract.is_broken()).withColumn(
            "digest", F.xxhash64("content")
        )
        return extract.file_nodes(versions, keep=KEPT, broken=True).withColumn("row", F.monotonically_increasing_id())

    def _in_time(self, accepted: DataFrame, batch_id: int, folder: str) -> DataFrame:
        """``accepted`` without the versions that a newer one of an earlier batch outranks.

        Where all versions are newer than what the store holds, two numbers tell so. Else
        keys are compared, and the shorter list of versions, late ones or those in time,
        meets the texts. Of equal ``seq`` all stay.
        """
        covered, folders = self._manifest(self.base.latest())
        parts = [p for p in (self._log(covered, batch_id)[1], self._state(folders)) if p is not None]
        if not parts:
            return accepted
        held = reduce(DataFrame.unionByName, [p.select(*KEYS, F.col("seq").alias("held")) for p in parts])
        key = [*KEYS, "seq"]
        # a batch is read anew, texts and all, whenever it is used: its keys are kept
        arrived = stage_at(accepted.select(*key), f"{folder}/arrived")
        newest, oldest = held.agg(F.max("held")).first()[0], arrived.agg(F.min("seq")).first()[0]
        if newest is None or oldest is None or oldest >= newest:
            return accepted
        # one row per file first, so that files of many versions do not meet pair by pair
        held = held.join(arrived.select(*KEYS), KEYS, "left_semi").groupBy(*KEYS).agg(F.max("held").alias("held"))
        outranked = arrived.join(held, KEYS).filter("held > seq").select(*key).distinct()
        late = stage_at(outranked, f"{folder}/late")
        n_late = late.count()
        if not n_late:
            return accepted
        if 2 * n_late <= arrived.count():
            return accepted.join(late, key, "left_anti")
        kept = stage_at(arrived.join(late, key, "left_anti"), f"{folder}/kept")
        same = reduce(Column.__and__, [accepted[name].eqNullSafe(kept[name]) for name in key])
        return accepted.join(kept, same, "left_semi")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Extract one micro-batch of file versions, but for those that are outranked
        already. Without late versions nothing is shuffled.

        Null content marks a deletion, which is kept so that it outranks the
        versions before it; so is a version with syntax errors, which has no node. Every COMPACT_EVERY batches the log is folded. A batch that
        has been folded already is not written again.
        """
        covered = self._covered()
        if batch_id <= covered:
            return
        arrivals = f"arrivals/{uuid.uuid4().hex}"
        accepted = self._in_time(scan.source_files(batch, self.config), batch_id, f"{self.root}/{arrivals}")
        extracted = self._extracted(accepted).write.mode("overwrite")
        extracted.parquet(f"{self.root}/batches/batch={batch_id}", compression=COMPRESSION)
        self._delete(arrivals)
        if batch_id - covered >= COMPACT_EVERY:
            self.compact()

    def _manifest(self, version: int | None) -> tuple[int, dict[int, str]]:
        """The last batch that a state holds (-1 without one), and the folder of each bucket."""
        if version is None:
            return -1, {}
        rows = self.base.load("manifest", version).collect()
        return rows[0]["covered"], {r["bucket"]: r["folder"] for r in rows if r["bucket"] is not None}

    def _covered(self) -> int:
        return self._manifest(self.base.latest())[0]

    def _folders(self, name: str) -> list[str]:
        """Names in a folder below the root; their number is bounded by the folds."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _log(self, after: int, before: int | None = None) -> tuple[int, DataFrame | None]:
        """The last batch there is, and the rows of those after the given one; with
        ``before``, only of batches before that."""
        batches = sorted(int(name.split("=")[1]) for name in self._folders("batches") if name.startswith("batch="))
        batches = [b for b in batches if b > after and (before is None or b < before)]
        if not batches:
            return after, None
        read = [
            self.spark.read.parquet(f"{self.root}/batches/batch={b}").withColumn("batch", F.lit(b).cast("long"))
            for b in batches
        ]
        return batches[-1], reduce(DataFrame.unionByName, read)

    def _state(self, folders: dict[int, str]) -> DataFrame | None:
        paths = [f"{self.root}/state/{folder}/bucket={bucket}" for bucket, folder in folders.items()]
        return self.spark.read.parquet(*paths) if paths else None

    def _bucket(self):
        return F.pmod(F.hash(*KEYS), F.lit(self.buckets))

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        """The newest version of every file, deletions included.

        The pick is by ``seq``, then batch, digest and place in the batch, so it is
        one row whatever ties there are. It aggregates five narrow columns, one row
        per file and task; the wide rows then meet the picks once.
        """
        order = F.max(F.struct("seq", "batch", "digest", "row")).alias("pick")
        picks = rows.groupBy(*KEYS).agg(order).select("pick.batch", "pick.row")
        return rows.join(picks, ["batch", "row"], "left_semi")

    def current(self) -> DataFrame:
        covered, folders = self._manifest(self.base.latest())
        parts = [p for p in (self._log(covered)[1], self._state(folders)) if p is not None]
        if not parts:
            nothing = self.spark.createDataFrame([], VERSION_SCHEMA)
            parts = [self._extracted(scan.source_files(nothing, self.config)).withColumn("batch", F.lit(0).cast("long"))]
        rows = self._newest(reduce(DataFrame.unionByName, parts))
        return rows.filter(~F.col("deleted")).drop("deleted", "digest", "batch", "row")

    def compact(self) -> None:
        """Fold the batches so far into the state. Buckets without arrivals stay as they
        are, so what is written follows the arrivals and not the state."""
        version = self.base.latest()
        before, folders = self._manifest(version)
        covered, log = self._log(before)
        if log is None:
            return
        touched = [r["bucket"] for r in log.select(self._bucket().alias("bucket")).distinct().collect()]
        folder = uuid.uuid4().hex
        rows, old = log, self._state({b: f for b, f in folders.items() if b in touched})
        if old is not None:
            rows = rows.unionByName(old)
        newest = self._newest(rows).withColumn("bucket", self._bucket())
        newest.write.partitionBy("bucket").parquet(f"{self.root}/state/{folder}", compression=COMPRESSION)
        following = folders | {b: folder for b in touched}
        manifest = [(b, f, covered) for b, f in following.items()] or [(None, None, covered)]
        table = self.spark.createDataFrame(manifest, "bucket int, folder string, covered long").coalesce(1)
        self.base.save(expected=version or 0, manifest=table)
        self._clear(version, folders, before)

    def _clear(self, version: int | None, folders: dict[int, str], covered: int) -> None:
        """Deletes what neither the newest state nor ``version``, the one before it, reads."""
        _, newest = self._manifest(self.base.latest())
        used = set(newest.values()) | set(folders.values())
        for folder in set(self._folders("state")) - used:
            self._delete(f"state/{folder}")
        needed = {(f, b) for manifest in (newest, folders) for b, f in manifest.items()}
        for folder in used:
            for name in self._folders(f"state/{folder}"):
                if name.startswith("bucket=") and (folder, int(name.split("=")[1])) not in needed:
                    self._delete(f"state/{folder}/{name}")
        for name in self._folders("batches"):
            if name.startswith("batch=") and int(name.split("=")[1]) <= covered:
                self._delete(f"batches/{name}")
        self.base.prune(keep=2)


def watch_sources(
    store: WatchStore, versions: DataFrame, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Feed a stream of file versions into ``store``; with ``once``, take what
    has arrived and stop."""
    writer = versions.writeStream.foreachBatch(store.upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
