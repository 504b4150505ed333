"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Staged tables are written once and hold much text: the codec that leaves least of it.
COMPRESSION = "zstd"

_local_dir: str | None = None


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "codeloom") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # call sites of columns are not needed, and cost a round trip per call
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def stage_root(spark: SparkSession) -> str:
    """The folder every executor can read, named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a
    cluster a machine-local folder would not survive the loss of its machine. A
    ``file:`` folder there must be a mount that all machines share.
    """
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if _local_dir is None or not os.path.isdir(_local_dir):
        _local_dir = tempfile.mkdtemp(prefix="codeloom-", dir="/tmp")
    return _local_dir


def run_folder(spark: SparkSession) -> str:
    """Where this application keeps its staged tables."""
    return f"{stage_root(spark)}/codeloom/{spark.sparkContext.applicationId}"


def new_stage_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes all that this application has staged. Results that still read from it
    must have been written elsewhere; nothing else in the shared folder is touched."""
    discard(spark, run_folder(spark))


def stage_at(df: DataFrame, path: str) -> DataFrame:
    """:func:`stage` under a path that :func:`discard` can delete before the run ends."""
    df.write.parquet(path, compression=COMPRESSION)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes one staged table that nothing will read again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage like a checkpoint, but keeps column pruning and file
    statistics, so the tables that several joins read stay cheap to re-scan.
    """
    return stage_at(df, new_stage_path(df.sparkSession, name))
