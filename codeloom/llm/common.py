"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Whole rows that an Arrow batch may hold: Spark bounds batches by rows only, and rows
# that carry their texts there and back take four copies of a batch.
BATCH_ROWS = 1_000
# Rows whose work a single Python task may hold at once.
GROUP_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after lowering the session's rows per Arrow batch to BATCH_ROWS where they
    are more. The setting stays, as plans read it when they run."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", docs.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return docs


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads; the text as UTF-8 bytes, which spares
    Python the decoding."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))


def map_texts(
    texts: DataFrame, one: Callable[[bytes | None], tuple], columns: dict[str, str], arrow: pa.Schema
) -> DataFrame:
    """``one(text)`` gives the values of ``columns`` for each row of ``id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(text) for text in batch.column("text").to_pylist()]
            values = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in arrow]
            arrays = [pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *arrays], names=["id", *arrow.names]
            )

    kind = texts.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"`{n}` {t}" for n, t in columns.items())])
    return texts.mapInArrow(run, schema)


def free_name(docs: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name where ``docs`` has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def add_columns(
    docs: DataFrame, text_col: str, one: Callable[[bytes | None], tuple], columns: dict[str, str],
    arrow: pa.Schema,
) -> DataFrame:
    """``docs`` with the values of ``one(text)`` appended, without a shuffle.

    The text travels as it is, with all other columns of its row. The names in
    ``columns`` must be free in ``docs``.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            rows = [one(text) for text in texts]
            values = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in arrow]
            arrays = [pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *arrays], names=[*batch.schema.names, *arrow.names]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    fields += [f"`{n}` {t}" for n, t in columns.items()]
    return small_batches(docs).mapInArrow(run, ", ".join(fields))
