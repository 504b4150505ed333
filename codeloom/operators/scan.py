"""Which files count, and as which language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.config import AnalysisConfig
from codeloom.functions import paths


def ignore_filter(files: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    return files.filter(~paths.ignored(F.col("path"), config.ignore))


def language_classify(files: DataFrame) -> DataFrame:
    """Add ``language`` and drop files no extractor takes."""
    return files.withColumn("language", paths.language(F.col("path"))).filter(
        F.col("language").isNotNull()
    )


def source_files(files: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    return language_classify(ignore_filter(files, config))


def source_lines(files: DataFrame) -> DataFrame:
    """``project, path, line, txt``, lines counted from 1."""
    return files.select(
        "project", "path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "txt")
    ).select("project", "path", (F.col("pos") + 1).alias("line"), "txt")
