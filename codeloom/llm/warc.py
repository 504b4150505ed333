"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress independently. A bundle ends with
a seek table (the public Zstandard seekable format, a skippable frame), so a reader
finds every frame from the last bytes of the file, and an index maps a record to its
frame and its offset in it. Bundles are written by the tasks that scanned the rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import new_stage_path, stage

MIN_REVISIT = 1000  # bytes; smaller payloads are never revisits
FRAME_BYTES = 1 << 18  # records are put into a frame until it holds so much
BUNDLE_BYTES = 1 << 26  # frames are put into a bundle until it holds so much, compressed
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
# A list of repeated payloads of up to so many rows (about 100 bytes each) is broadcast.
BROADCAST_ROWS = 100_000

# Fixed values of the seekable format and of WARC.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_VERSION = b"WARC/1.1\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Names of stores that Arrow does not know, and the ones it has for them.
_STORES = {"s3a": "s3", "s3n": "s3"}


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host under which Spark itself finds it: one without a
    scheme lies on the default file system, which on a cluster is not the local one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def open_fs(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a shared folder, from tasks and the driver alike. Schemes that
    only Hadoop knows are opened by the common name of their store."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return arrow_fs.LocalFileSystem(), path
    return arrow_fs.FileSystem.from_uri(_STORES.get(scheme, scheme) + colon + rest)


# ---- records


def record_bytes(row: dict) -> bytes:
    """One record: WARC headers, and for a response its payload."""
    uri = quote(row["uri"] or "", safe="".join(map(chr, range(33, 127))))
    head = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<urn:record:{row['id']}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("X-Payload-Length", str(row["payload_bytes"])),
    ]
    body = b""
    if row["record_type"] == "revisit":
        head += [("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:record:{row['refers_to']}>")]
    else:
        body = row["payload"]
        head.append(("Content-Type", "text/html; charset=utf-8"))
    head.append(("Content-Length", str(len(body))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return _VERSION + lines + b"\r\n" + body + b"\r\n\r\n"


def _urn(value: str) -> int | None:
    text = value.removeprefix("<urn:record:").removesuffix(">")
    return None if text == "None" else int(text)


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at an offset and the offset of the next. Raises ValueError on
    anything that is no record or does not match its digest."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(_VERSION, at) or end < 0:
        raise ValueError(f"no record at {at}")
    head = dict(
        line.split(": ", 1) for line in data[at + len(_VERSION) : end].decode().split("\r\n")
    )
    start, size = end + 4, int(head["Content-Length"])
    body = data[start : start + size]
    row = {
        "id": _urn(head["WARC-Record-ID"]),
        "uri": head["WARC-Target-URI"],
        "record_type": head["WARC-Type"],
        "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(head["X-Payload-Length"]),
        "refers_to": None,
        "payload": None,
    }
    if row["record_type"] == "revisit":
        row["refers_to"] = _urn(head["WARC-Refers-To"])
    else:
        if len(body) != row["payload_bytes"] or hashlib.sha1(body).hexdigest() != row["payload_digest"]:
            raise ValueError(f"payload of record {row['id']} is damaged")
        row["payload"] = body
    return row, start + size + 4


# ---- bundles


@dataclass
class Frame:
    offset: int
    size: int
    raw: int


class BundleWriter:
    """Writes frames to one file and the seek table behind them."""

    def __init__(self, path: str):
        self.path, self.frames, self.size = path, [], 0
        system, local = open_fs(path)
        system.create_dir(local.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(local, compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, raw: bytes) -> Frame:
        packed = self.packer.compress(raw)
        frame = Frame(self.size, len(packed), len(raw))
        self.out.write(packed)
        self.frames.append(frame)
        self.size += len(packed)
        return frame

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", f.size, f.raw) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


def read_seek_table(path: str) -> list[Frame]:
    """The frames of a bundle, from its last bytes."""
    system, local = open_fs(path)
    with system.open_input_file(local) as file:
        size = file.size()
        count, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entries = file.read_at(8 * count, size - 9 - 8 * count)
    frames, offset = [], 0
    for packed, raw in struct.iter_unpack("<II", entries):
        frames.append(Frame(offset, packed, raw))
        offset += packed
    return frames


def read_frame(path: str, offset: int, size: int) -> bytes:
    system, local = open_fs(path)
    with system.open_input_file(local) as file:
        return zstandard.ZstdDecompressor().decompress(file.read_at(size, offset))


# ---- jobs

_RECORD = (
    "id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long"
)
_ARROW = {
    "id": pa.int64(), "uri": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(),
    "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary(),
}


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Columns of a record for each row.

    Of the records with equal payloads (by SHA-1 and length) of ``MIN_REVISIT`` bytes
    or more, that with the largest id is the response; the others revisit it and carry
    no payload. A null payload is empty. Rows that repeat the largest id are responses
    all; rows with a null id revisit, if another row has an id, and else are responses.

    The table is read twice, narrow for the digests and wide for the archive: only
    digests are shuffled, combined before that, and never a payload.
    """
    octets = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("uri"), octets.alias("payload"),
        F.sha1(octets).alias("payload_digest"), F.octet_length(octets).cast("long").alias("payload_bytes"),
    )
    repeated = stage(
        rows.filter(F.col("payload_bytes") >= MIN_REVISIT)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("id").alias("response"), F.count("*").alias("n"))
        .filter("n > 1 and response is not null")
        .drop("n"),
        "repeated-payloads",
    )
    few = repeated.count() <= BROADCAST_ROWS
    joined = rows.join(
        F.broadcast(repeated) if few else repeated, ["payload_digest", "payload_bytes"], "left"
    )
    again = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response"))
    return joined.select(
        "id", "uri", F.when(again, "revisit").otherwise("response").alias("record_type"), "payload_digest",
        "payload_bytes", F.when(again, F.col("response")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archives(records: DataFrame, root: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes bundles below ``root`` and returns the index, one row per record:
    ``id, file, frame_offset, frame_bytes, record_offset, record_bytes``.

    Bundles carry the number of the task attempt in their names, and only those of
    attempts that Spark committed are in the index: a lost or repeated task leaves at
    most a file that nobody reads. A task holds one frame besides an Arrow batch. ``root``
    is qualified by the driver, so that all tasks write where Spark would.
    """
    root = qualified(records.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{root}/{context.partitionId():06d}-{context.taskAttemptId()}"
        bundle, made = None, 0
        held, offsets, raw = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal bundle, made, held, offsets, raw
            if bundle is None:
                bundle, made = BundleWriter(f"{name}-{made:04d}.warc.zst"), made + 1
            frame = bundle.add(b"".join(data for _, data in held))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in held], pa.int64()),
                    pa.array([bundle.path] * len(held), pa.string()),
                    pa.array([frame.offset] * len(held), pa.int64()),
                    pa.array([frame.size] * len(held), pa.int64()),
                    pa.array(offsets, pa.int64()),
                    pa.array([len(data) for _, data in held], pa.int64()),
                ],
                names=["id", "file", "frame_offset", "frame_bytes", "record_offset", "record_bytes"],
            )
            held, offsets, raw = [], [], 0
            if bundle.size >= bundle_bytes:
                bundle.close()
                bundle = None
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                data = record_bytes(row)
                held.append((row["id"], data))
                offsets.append(raw)
                raw += len(data)
                if raw >= frame_bytes:
                    yield flush()
        if held:
            yield flush()
        if bundle is not None:
            bundle.close()

    index = records.mapInArrow(
        run,
        "id long, file string, frame_offset long, frame_bytes long, record_offset long, record_bytes long",
    )
    return stage(index, "warc-index")


def _record_batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([row[n] for row in rows], _ARROW[n]) for n in names], names=names
    )


def read_archives(index: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the bundles that ``index`` names, frame by frame.

    The seek table of each file gives its frames, which are then dealt out evenly, so
    a large bundle is read by many tasks. Digests are verified on the way.
    """

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("file").to_pylist():
                found = read_seek_table(path)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(found), pa.string()),
                        pa.array([f.offset for f in found], pa.int64()),
                        pa.array([f.size for f in found], pa.int64()),
                    ],
                    names=["file", "offset", "size"],
                )

    names = [n for n in _ARROW if payload or n != "payload"]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset, size in zip(*(c.to_pylist() for c in batch.columns)):
                data, at, rows = read_frame(path, offset, size), 0, []
                while at < len(data):
                    row, at = parse_record(data, at)
                    rows.append(row)
                yield _record_batch(rows, names)

    listed = index.select("file").distinct().mapInArrow(frames, "file string, offset long, size long")
    return listed.repartition("file", "offset").mapInArrow(
        records, _RECORD + (", payload binary" if payload else "")
    )


def fetch(index: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The records of ``ids`` only: each is cut from its frame, other frames stay unread."""
    wanted = index.join(ids.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                data = read_frame(x["file"], x["frame_offset"], x["frame_bytes"])
                rows.append(parse_record(data, x["record_offset"])[0])
            yield _record_batch(rows, list(_ARROW))

    return wanted.mapInArrow(cut, _RECORD + ", payload binary")


def round_trip(spark: SparkSession, pages: DataFrame, payload: bool = False) -> DataFrame:
    """Archives ``pages`` in the shared folder and reads all records back."""
    index = write_archives(with_revisits(pages), new_stage_path(spark, "warc"))
    return read_archives(index, payload)
