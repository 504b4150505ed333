"""Versioned snapshots of extracted files, as Parquet."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession

from codeloom.session import COMPRESSION

KEYS = ("project", "path")


class Conflict(RuntimeError):
    """Another save has come between reading a version and saving the next one."""


class SnapshotStore:
    """Each save writes folders of its own and then a commit record.

    Readers follow the commit records, so a save that dies half-way is never
    read, and no path is overwritten while it is being read. A record is created under
    the name of its version only if there is none: of two savers that started from one
    version, the second takes the next number, or is told so if it named the version it
    started from. Local and HDFS paths create files so; on a store that cannot, savers
    must take turns.

    With ``buckets``, tables of files are bucketed and sorted by project and path, so
    that joins of such tables on these keys need no exchange. Take at least as many as
    ``spark.sql.shuffle.partitions``; with fewer Spark may deal the rows out again. They
    are read as external tables, which each session enters into its catalog.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    def _commit(self, version: int | None = None) -> Row | None:
        """The newest commit record, or that of a version."""
        try:
            commits = self.spark.read.schema("version long, folder string, buckets int").json(f"{self.root}/commits")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        commits = commits.filter("folder is not null")
        if version is not None:
            commits = commits.filter(commits["version"] == version)
        return commits.orderBy("version", "folder", ascending=False).first()

    def latest(self) -> int | None:
        commit = self._commit()
        return None if commit is None else commit["version"]

    def _create(self, name: str, text: str) -> bool:
        """Writes a file unless there is one of that name; whether it did."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.root}/commits/{name}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        system.mkdirs(path.getParent())
        local = system.makeQualified(path).toUri()
        if local.getScheme() == "file":
            # linking a complete file is exclusive and never shows half of it
            target = local.getPath()
            part = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8") as file:
                file.write(text)
            try:
                os.link(part, target)
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        try:
            out = system.create(path, False)
        except Py4JJavaError as error:
            if system.exists(path):
                return False
            raise error
        out.write(bytearray(text, "utf-8"))
        out.close()
        return True

    def _bucketed(self, df: DataFrame) -> bool:
        return bool(self.buckets) and set(KEYS) <= set(df.columns)

    def deal(self, df: DataFrame) -> DataFrame:
        """``df``, where it is bucketed, with its rows dealt out as the buckets are.

        Dealing out what a wider table is computed from, row by row, spares the shuffle of
        that table: name it in ``dealt`` when it is saved."""
        return df.repartition(self.buckets, *KEYS) if self._bucketed(df) else df

    def save(self, expected: int | None = None, dealt: tuple[str, ...] = (), **tables: DataFrame) -> int:
        """Write the tables, by name, as the next version, whose number is returned.
        Those named in ``dealt`` come from rows dealt out by :meth:`deal`.

        With ``expected`` the save is refused by ``Conflict`` unless the newest version
        is that one (0: none) when it is committed.
        """
        folder = uuid.uuid4().hex
        for name, df in tables.items():
            path = f"{self.root}/{name}/{folder}"
            if self._bucketed(df):
                # dealt out as the buckets are, so that a bucket is one file
                table = f"snapshot_{name}_{folder}"
                rows = df if name in dealt else self.deal(df)
                writer = rows.write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS)
                writer.option("path", path).option("compression", COMPRESSION).saveAsTable(table)
            else:
                df.write.parquet(path, compression=COMPRESSION)
        version = (self.latest() or 0) + 1
        while True:
            if expected is not None and version != expected + 1:
                raise Conflict(f"version {version - 1} has been saved after version {expected}")
            record = {"version": version, "folder": folder, "buckets": self.buckets}
            if self._create(f"v-{version:012d}.json", json.dumps(record)):
                return version
            version += 1

    def load(self, name: str, version: int | None = None) -> DataFrame:
        commit = self._commit(version)
        if commit is None:
            raise ValueError(f"no such snapshot has been saved in {self.root}")
        path = f"{self.root}/{name}/{commit['folder']}"
        plain = self.spark.read.parquet(path)
        if not commit["buckets"] or not set(KEYS) <= set(plain.columns):
            return plain
        table = f"snapshot_{name}_{commit['folder']}"
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
            keys = ", ".join(KEYS)
            self.spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
                f"INTO {commit['buckets']} BUCKETS LOCATION '{path}'"
            )
        return self.spark.table(table)

    def prune(self, keep: int) -> None:
        """Deletes all but the newest ``keep`` versions, records first. A session that has
        entered their tables into its catalog should drop them there."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.root)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        commits = hadoop.Path(f"{self.root}/commits")
        if not system.exists(commits):
            return
        records = sorted(s.getPath().getName() for s in system.listStatus(commits) if s.getPath().getName().startswith("v-"))
        gone = records[: max(0, len(records) - keep)]
        folders = set()
        for name in gone:
            row = self.spark.read.schema("version long, folder string").json(f"{self.root}/commits/{name}").first()
            folders |= {row["folder"]} if row else set()
            system.delete(hadoop.Path(f"{self.root}/commits/{name}"), False)
        for table in system.listStatus(root):
            name = table.getPath().getName()
            for folder in folders if name != "commits" else ():
                system.delete(hadoop.Path(f"{self.root}/{name}/{folder}"), True)
