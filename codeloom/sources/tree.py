"""Source files from a directory tree or from a corpus table."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.config import AnalysisConfig
from codeloom.functions import paths
from codeloom.session import stage

COLUMNS = ("project", "path", "content")
# Directories that a task lists, files that it reads, and bytes of files that it hands on
# at once.
LIST_ROWS, READ_ROWS, READ_BYTES = 64, 2_000, 16 << 20
_ENTRY = "project string, path string, name string, location binary, is_dir boolean, size long"


def scan_tree(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """Every file below ``root`` as ``project, path, content``.

    With ``project`` the whole tree is that project; without, each first-level
    directory is one. Unreadable files are skipped, invalid UTF-8 is replaced.
    Listing many small files is slow: for a large corpus, load once and keep the
    result as a Parquet table for :func:`scan_table`. :func:`walk_tree` does not enter
    ignored directories.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    prefix = base.getFileSystem(conf).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .load(root)
    )
    location = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z0-9]+:/*(?=/)", "")
    located = raw.select(
        F.url_decode(F.replace(location, F.lit("+"), F.lit("%2B"))).alias("location"), "content"
    )
    below = F.substr(F.col("location"), F.instr(F.col("location"), prefix) + len(prefix))
    content = F.make_valid_utf8(F.col("content").cast("string"))
    files = located.select(below.alias("path"), content.alias("content"))
    if project is not None:
        return files.select(F.lit(project).alias("project"), "path", "content")
    return files.filter(F.col("path").contains("/")).select(
        F.substring_index("path", "/", 1).alias("project"),
        F.expr("substr(path, instr(path, '/') + 1)").alias("path"),
        "content",
    )


def _store(location: str) -> tuple[fs.FileSystem | None, str]:
    """The file system of a location and the path there; None for the local one."""
    if location.startswith("/"):
        return None, location
    if location.startswith("file:"):
        return None, "/" + location[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(location)


def _entries(location: str) -> Iterator[tuple[str, str, bool, int]]:
    """Name, location, whether it is a directory, and size of what lies in a directory;
    nothing for one that cannot be listed. Links to directories are not followed."""
    store, path = _store(location)
    try:
        if store is None:
            with os.scandir(os.fsdecode(path)) as found:
                for entry in found:
                    kind = entry.stat(follow_symlinks=False)
                    yield entry.name, entry.path, stat.S_ISDIR(kind.st_mode), kind.st_size
        else:
            scheme = location.split(":", 1)[0]
            root = location[: location.index("/", len(scheme) + 3)] if "://" in location else f"{scheme}:"
            for info in store.get_file_info(fs.FileSelector(path)):
                at = root + "/" + info.path.lstrip("/")
                yield info.base_name, at, info.type == fs.FileType.Directory, info.size or 0
    except OSError:
        return


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rows = []
            for name, location, is_dir, size in _entries(os.fsdecode(row["location"])):
                shown = os.fsencode(name).decode("utf-8", "replace")
                path = f"{row['path']}/{shown}" if row["path"] else shown
                rows.append((row["project"], path, shown, os.fsencode(location), is_dir, size))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in range(6)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["project", "path", "name", "location", "is_dir", "size"],
            )


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*rows, strict=True)]
        kinds = [pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["project", "path", "content"]
        )

    rows, held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            store, path = _store(os.fsdecode(row["location"]))
            try:
                if store is None:
                    with open(path, "rb") as file:
                        content = file.read()
                else:
                    with store.open_input_stream(path) as file:
                        content = file.read()
            except OSError:
                continue  # unreadable, gone, or a link to a directory
            rows.append((row["project"], row["path"], content))
            held += len(content)
            if held >= READ_BYTES:
                yield packed(rows)
                rows, held = [], 0
    if rows:
        yield packed(rows)


def list_tree(
    spark: SparkSession, root: str, config: AnalysisConfig = AnalysisConfig(), project: str | None = None
) -> DataFrame:
    """``project, path, name, location, is_dir, size, kept`` of every entry that is looked at
    below ``root``, level by level.

    An ignored directory is seen as an entry of its parent (``kept`` is false) but never
    entered, so what lies in it costs nothing. Each level is a job over the directories
    of the last one and is written, so a lost task lists again only what it had. The
    root's own name is not tested, nor are, without ``project``, those of the projects,
    which are the first-level directories; files beside them belong to none.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    location = base.getFileSystem(conf).makeQualified(base).toString()
    start = [(project, "", bytearray(os.fsencode(location)))]
    frontier = spark.createDataFrame(start, "project string, path string, location binary")
    found, known = None, project is not None
    while True:
        level = frontier.mapInArrow(_listed, _ENTRY)
        if known:
            level = level.withColumn("kept", ~paths.ignored(F.col("name"), config.ignore))
        else:
            level = level.filter("is_dir").select(
                F.col("name").alias("project"), F.lit("").alias("path"), "name", "location", "is_dir", "size",
                F.lit(True).alias("kept"),
            )
        level = stage(level, "tree-level")
        if known:
            found = level if found is None else found.unionByName(level)
        directories = level.filter("is_dir and kept").select("project", "path", "location")
        count = directories.count()
        if not count:
            return level if found is None else found
        known = True
        # one directory may hold most of the next level: they are dealt out by number
        frontier = directories.repartition(-(-count // LIST_ROWS), "location")


def walk_tree(
    spark: SparkSession, root: str, config: AnalysisConfig = AnalysisConfig(), project: str | None = None
) -> DataFrame:
    """``project, path, content`` of the source files below ``root`` which are not ignored.

    Equals ``source_files(scan_tree(...))`` less its language, but ignored directories
    are not listed and no file is read that no extractor takes. Unreadable files are
    skipped, invalid UTF-8 is replaced.
    """
    listed = list_tree(spark, root, config, project)
    wanted = listed.filter(~F.col("is_dir") & F.col("kept") & paths.language(F.col("path")).isNotNull())
    count = wanted.count()
    files = wanted.select("project", "path", "location").repartition(max(1, -(-count // READ_ROWS)), "location")
    read = files.mapInArrow(_contents, "project string, path string, content binary")
    return read.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """A corpus already stored as Parquet with ``project, path, content``."""
    return spark.read.parquet(path).select(*COLUMNS)
