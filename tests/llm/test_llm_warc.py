"""WARC bundles: exact round trips, seek tables and single look-ups."""

import hashlib
import random

import pytest
import zstandard

from codeloom.llm import warc
from codeloom.session import new_stage_path

PAGES = "page_id long, url string, html string, id int, payload string"


def rows():
    rng = random.Random(1)
    body = lambda n: "".join(rng.choice("<p>ä\r\n WARC/1.1") for _ in range(n))
    same, small = body(3000), "tiny"
    out = [(i, f"http://x/{i}", body(rng.choice([0, 10, 999, 1000, 5000])), 1, "p") for i in range(40)]
    out += [(100, "u", same, 1, ""), (300, None, same, 1, ""), (200, "u\r\nInjected: 1", same, 1, ""), (201, "ü ö", same, 1, "")]
    out += [(400, "", small, 1, ""), (401, "", small, 1, ""), (402, "x", None, 1, ""), (403, "x", "", 1, "")]
    out += [(500, "a", "z" * 2_000_000, 1, ""), (501, "a", "x" * 999, 1, ""), (502, "a", "x" * 999, 1, ""), (503, "a", "x" * 1000, 1, ""), (504, "a", "x" * 1000, 1, "")]
    out += [(600, "r", "repeat" * 300, 1, ""), (600, "r", "repeat" * 300, 1, ""), (None, "n", "repeat" * 300, 1, ""), (None, "n", "nobody" * 300, 1, "")]
    return out


@pytest.fixture(scope="module")
def archive(spark):
    pages = spark.createDataFrame(rows(), PAGES).repartition(3)
    return warc.write_archives(warc.with_revisits(pages), new_stage_path(spark, "t"), frame_bytes=4000, bundle_bytes=8000)


def test_round_trip(archive):
    got = warc.read_archives(archive).collect()
    wanted, best = [], {}
    for page, _, html, *_ in rows():
        data = (html or "").encode()
        if page is not None and len(data) >= 1000:
            best[data] = max(best.get(data, page), page)
    for page, _, html, *_ in rows():
        data = (html or "").encode()
        top = best.get(data)
        again = top is not None and top != page
        wanted.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None, None if again else data))
    key = lambda r: tuple(map(repr, r))
    mine = [(r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(mine, key=key) == sorted(wanted, key=key)
    assert not any("\r" in (r["uri"] or "") for r in got)


def test_frames_are_independent_and_listed(archive):
    files = [r["file"] for r in archive.select("file").distinct().collect()]
    assert len(files) > 3
    for path in files:
        local = warc.open_fs(path)[1]
        data = open(local, "rb").read()
        frames = warc.read_seek_table(path)
        for frame in reversed(frames):
            raw = zstandard.ZstdDecompressor().decompress(data[frame.offset : frame.offset + frame.size])
            assert len(raw) == frame.raw and raw.startswith(b"WARC/1.1\r\n")
        # any Zstandard reader takes the file as a stream and skips the table
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert len(whole) == sum(f.raw for f in frames)


def test_single_records_are_fetched_by_offset(spark, archive):
    wanted = spark.createDataFrame([(200,), (500,), (402,), (500,), (12345,)], "id long")
    got = {r["id"]: r for r in warc.fetch(archive, wanted).collect()}
    assert sorted(got) == [200, 402, 500]
    assert bytes(got[500]["payload"]) == b"z" * 2_000_000 and got[200]["refers_to"] == 300


def test_damage_is_noticed():
    row = {"id": 1, "uri": "u", "record_type": "response", "payload": b"abc", "payload_bytes": 3, "refers_to": None, "payload_digest": hashlib.sha1(b"abc").hexdigest()}
    data = warc.record_bytes(row)
    assert warc.parse_record(data, 0)[1] == len(data)
    with pytest.raises(ValueError):
        warc.parse_record(data.replace(b"abc", b"abd"), 0)
    with pytest.raises(ValueError):
        warc.parse_record(data, 1)


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_folders_are_those_that_spark_finds(spark, archive, tmp_path):
    assert warc.qualified(spark, f"{tmp_path}/a") == f"file:{tmp_path}/a"
    assert warc.qualified(spark, f"file://{tmp_path}/a").startswith("file:/")
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://cluster/")
    conf.set("fs.viewfs.mounttable.cluster.link./shared", f"file://{tmp_path}")
    try:
        assert warc.qualified(spark, "/shared/a") == "viewfs://cluster/shared/a"
    finally:
        conf.set("fs.defaultFS", before)
    assert {r["file"].split(":")[0] for r in archive.select("file").collect()} == {"file"}
    for path in (f"file:{tmp_path}/x", f"file://{tmp_path}/x", f"{tmp_path}/x"):
        system, local = warc.open_fs(path)
        assert system.type_name == "local" and local == f"{tmp_path}/x"
