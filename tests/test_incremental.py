import os

import pytest

from codeloom.operators import incremental, scan
from codeloom.sources.snapshot import Conflict, SnapshotStore
from codeloom.streaming.watch import VERSION_SCHEMA, WatchStore, watch_sources

BEFORE = {"a.py": "def a(): pass\n", "b.py": "def b(): pass\n", "c.py": "def c(): pass\n"}
AFTER = {"a.py": "def a(): pass\n", "b.py": "def b2(): pass\n", "d.py": "def d(): pass\n"}


def functions(nodes):
    return {r.path: [f.name for f in r.functions] for r in nodes.collect()}


def test_changes(files):
    rows = incremental.changed_files(files(BEFORE), files(AFTER)).collect()
    assert {r.path: r.status for r in rows} == {
        "a.py": "unchanged", "b.py": "modified", "c.py": "deleted", "d.py": "added",
    }
    kept = incremental.digests(files(BEFORE))
    assert incremental.changed_files(kept, files(AFTER)).filter("status = 'unchanged'").count() == 1


def test_merge_keeps_deleted_files(nodes_of):
    merged = incremental.merge_nodes(nodes_of(BEFORE), nodes_of(AFTER))
    assert functions(merged) == {"a.py": ["a"], "b.py": ["b2"], "c.py": ["c"], "d.py": ["d"]}


def test_refresh_equals_full_rebuild(files, nodes_of):
    refreshed = incremental.incremental_refresh(nodes_of(BEFORE), files(BEFORE), files(AFTER))
    full = nodes_of(AFTER)
    assert refreshed.schema == full.schema
    assert sorted(map(str, refreshed.collect())) == sorted(map(str, full.collect()))


def test_refresh_extracts_only_changes(files, nodes_of):
    cached = nodes_of({"a.py": "def from_cache(): pass\n", "b.py": "", "c.py": ""})
    refreshed = incremental.incremental_refresh(cached, files(BEFORE), files(AFTER))
    assert functions(refreshed)["a.py"] == ["from_cache"]


def test_snapshots(spark, files, nodes_of, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "snap"))
    assert store.latest() is None
    with pytest.raises(ValueError):
        store.load("nodes")
    assert store.save(nodes=nodes_of(BEFORE), digests=incremental.digests(files(BEFORE))) == 1
    # a folder without a commit record is not read
    nodes_of({"x.py": ""}).write.parquet(str(tmp_path / "snap/nodes/left-over"))
    assert store.latest() == 1 and set(functions(store.load("nodes"))) == set(BEFORE)
    refreshed = incremental.incremental_refresh(store.load("nodes"), store.load("digests"), files(AFTER))
    assert store.save(nodes=refreshed, digests=incremental.digests(files(AFTER))) == 2
    assert set(functions(store.load("nodes"))) == set(AFTER)
    assert set(functions(store.load("nodes", version=1))) == set(BEFORE)


@pytest.fixture()
def watched(spark, tmp_path):
    store = WatchStore(spark, str(tmp_path / "store"))

    def feed(*versions):
        table = spark.createDataFrame(list(versions), VERSION_SCHEMA)
        table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(VERSION_SCHEMA).parquet(str(tmp_path / "in"))
        watch_sources(store, stream, str(tmp_path / "cp")).awaitTermination()
        return {r.path: (r.seq, [f.name for f in r.functions]) for r in store.current().collect()}

    return store, feed


def test_late_versions_and_deletions(watched):
    _, feed = watched
    assert feed(("p", "a.py", 2, "def new(): pass"), ("p", "b.py", 5, None), ("p", "x.md", 1, "")) == {
        "a.py": (2, ["new"])
    }
    assert feed(
        ("p", "a.py", 1, "def old(): pass"), ("p", "b.py", 4, "def gone(): pass"),
        ("p", "c.py", 1, "def c1(): pass"), ("p", "c.py", 3, "def c3(): pass"),
    ) == {"a.py": (2, ["new"]), "c.py": (3, ["c3"])}
    assert feed(("p", "b.py", 6, "def back(): pass"), ("p", "a.py", 3, None)) == {
        "b.py": (6, ["back"]), "c.py": (3, ["c3"]),
    }


def test_replayed_batch_changes_nothing(spark, watched):
    store, feed = watched
    first = feed(("p", "a.py", 1, "def a(): pass"))
    feed(("p", "a.py", 2, "def b(): pass"))
    before = store.current().collect()
    replay = spark.createDataFrame([("p", "a.py", 1, "def a(): pass")], VERSION_SCHEMA)
    store.upsert(replay, 0)
    assert store.current().collect() == before and first == {"a.py": (1, ["a"])}
    log = spark.read.parquet(f"{store.root}/batches")
    assert log.count() == 2


def test_compaction_keeps_the_state(watched):
    store, feed = watched
    feed(("p", "a.py", 3, "def a(): pass"), ("p", "b.py", 2, None))
    before = store.current().collect()
    store.compact()
    assert store.current().collect() == before
    assert feed(("p", "b.py", 1, "def late(): pass"), ("p", "c.py", 1, "")) == {
        "a.py": (3, ["a"]), "c.py": (1, []),
    }
    store.compact()
    assert feed(("p", "a.py", 4, None)) == {"c.py": (1, [])}


def test_stream_equals_batch(watched, nodes_of):
    store, feed = watched
    feed(*[("p", path, 1, text) for path, text in BEFORE.items()])
    feed(*[("p", path, 2, text) for path, text in AFTER.items()], ("p", "c.py", 2, None))
    got = store.current().drop("seq")
    full = nodes_of(AFTER)
    assert sorted(map(str, got.select(*full.columns).collect())) == sorted(map(str, full.collect()))


def test_only_digests_are_shuffled(files):
    plan = incremental.changed_files(files(BEFORE), files(AFTER))._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join"):]
    assert "sha2" in join and "content" not in join[: join.index("sha2")]


def test_null_contents_are_there(files):
    texts = {"both": (None, None), "gone": ("a", None), "new": (None, "b"), "same": ("c", "c")}
    before = files([("p", k, a) for k, (a, _) in texts.items()] + [("p", "old", None)])
    after = files([("p", k, b) for k, (_, b) in texts.items()] + [("p", "fresh", None)])
    got = {r.path: r.status for r in incremental.changed_files(before, after).collect()}
    assert got == {
        "both": "unchanged", "gone": "modified", "new": "modified", "same": "unchanged",
        "old": "deleted", "fresh": "added",
    }


def test_two_savers_from_one_version_both_survive(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "snap"))
    one, two = spark.range(3), spark.range(10, 12)
    monkeypatch.setattr(store, "latest", lambda: None)  # both see no version yet
    assert store.save(a=one, b=one) == 1 and store.save(a=two, b=two) == 2
    with pytest.raises(Conflict):
        store.save(expected=0, a=two)
    monkeypatch.undo()
    assert store.latest() == 2
    assert sorted(store.load("a", 1).collect()) == sorted(store.load("b", 1).collect()) == sorted(one.collect())
    assert sorted(store.load("a").collect()) == sorted(store.load("b").collect()) == sorted(two.collect())
    with pytest.raises(Conflict):
        store.save(expected=1, a=one)
    assert store.save(expected=2, a=one) == 3
    assert not [f for f in os.listdir(tmp_path / "snap" / "commits") if f.startswith(".") and not f.endswith(".crc")]


def test_records_are_created_once(spark, tmp_path):
    """The other branch: files that the file system itself creates exclusively."""
    store = SnapshotStore(spark, f"viewfs://snapshots{tmp_path}/snap")
    conf = spark._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.snapshots.link.{tmp_path}", f"file://{tmp_path}")
    assert store._create("v-1.json", '{"version": 1, "folder": "x"}')
    assert not store._create("v-1.json", '{"version": 1, "folder": "y"}')
    assert store._commit()["folder"] == "x"


MOVES_BEFORE = {
    "a.py": "def a(): pass\n", "b.py": "def b(): pass\n", "c.js": "function c() {}\n", "d.go": "package d\nfunc D() {}\n",
}
MOVES_AFTER = {
    "a.py": "def a(): pass\n",  # unchanged
    "sub/b.py": "def b(): pass\n",  # moved
    "c.js": "function c() {}\n", "c2.js": "function c() {}\n",  # copied
    "c3.ts": "function c() {}\n",  # the same text in another language
    "d.go": "package d\nfunc E() {}\n",  # modified
    "x.py": "def x(): pass\n", "y.py": "def x(): pass\n", "z.py": "",  # new, two alike
}


@pytest.mark.parametrize("buckets", [None, 8])
def test_refresh_by_content(spark, files, nodes_of, tmp_path, buckets):
    store = SnapshotStore(spark, str(tmp_path / "snap"), buckets)
    store.save(nodes=incremental.nodes_with_digest(scan.source_files(files(MOVES_BEFORE))), files=files(MOVES_AFTER))
    found = incremental.refresh_by_content(store.load("nodes"), store.load("files"))
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(found.unchanged) == ["a.py", "c.js"]
    assert paths(found.copied) == ["c2.js", "sub/b.py", "y.py"]
    assert paths(found.extracted) == ["c3.ts", "d.go", "x.py", "z.py"]
    full = nodes_of(MOVES_AFTER)
    got = found.nodes.select(*full.columns)
    assert got.schema == full.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, full.collect()))
    # a second refresh, from the result of the first
    store.save(nodes=found.nodes, files=files(MOVES_BEFORE | {"n.py": None}))
    back = incremental.refresh_by_content(store.load("nodes"), store.load("files"))
    full = nodes_of(MOVES_BEFORE | {"n.py": None})
    assert sorted(map(str, back.nodes.select(*full.columns).collect())) == sorted(map(str, full.collect()))
    # d.go is modified again and n.py is new; b.py is where sub/b.py was taken from
    assert paths(back.extracted) == ["d.go", "n.py"] and paths(back.copied) == ["b.py"]


def exchanged(df):
    """The columns of every shuffle in the plan of a query."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    below = []
    for i, line in enumerate(plan):
        if "Exchange hashpartitioning" in line:
            below.append("\n".join(plan[i + 1 : i + 6]))
    return below


def test_bucketed_tables_join_without_an_exchange_of_wide_rows(spark, files, tmp_path, monkeypatch):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    store = SnapshotStore(spark, str(tmp_path / "snap"), 8)
    cached = incremental.nodes_with_digest(scan.source_files(files(MOVES_BEFORE)))
    store.save(nodes=cached, files=files(MOVES_AFTER))
    plans = []
    written = incremental.stage

    def stage(df, name):
        plans.append((name, exchanged(df)))
        return written(df, name)

    monkeypatch.setattr(incremental, "stage", stage)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        incremental.refresh_by_content(store.load("nodes"), store.load("files"))
        merged = incremental.merge_nodes(store.load("nodes"), store.load("nodes"))
        assert exchanged(merged) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    found = dict(plans)
    assert found["compared"] == []
    for name in ("known-contents", "new-contents"):
        assert found[name] and not [x for x in found[name] if "content#" in x or "functions#" in x]


def test_nodes_of_dealt_texts_are_saved_without_an_exchange(spark, files, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "snap"), 8)
    sources = scan.source_files(files(MOVES_BEFORE))
    nodes = incremental.nodes_with_digest(store.deal(sources))
    assert not [x for x in exchanged(nodes) if "functions#" in x]
    store.save(dealt=("nodes",), nodes=nodes)
    written = list((tmp_path / "snap" / "nodes").glob("*/part-*"))
    assert len({f.name.split("_")[-1] for f in written}) == len(written)  # a file a bucket
    plain = incremental.nodes_with_digest(sources)
    rows = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert rows(store.load("nodes")) == rows(plain)


def test_other_sessions_read_bucketed_snapshots(spark, files, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "snap"), 4)
    store.save(files=files(MOVES_AFTER), other=spark.range(3))
    for row in spark.sql("SHOW TABLES").collect():
        if row.tableName.startswith("snapshot_files_"):
            spark.sql(f"DROP TABLE {row.tableName}")
    again = SnapshotStore(spark, str(tmp_path / "snap"))
    assert again.load("files").count() == len(MOVES_AFTER) and again.load("other").count() == 3
    assert "SelectedBucketsCount" in again.load("files").groupBy("project", "path").count()._jdf.queryExecution().toString()


def test_equal_versions_leave_one_row(watched):
    store, feed = watched
    feed(("p", "a.py", 1, "def x(): pass"), ("p", "a.py", 1, "def y(): pass"), ("p", "a.py", 1, "def y(): pass"))
    feed(("p", "a.py", 1, "def z(): pass"))
    assert [f.name for r in store.current().collect() for f in r.functions] == ["z"]


def test_the_log_is_folded_by_itself(watched, monkeypatch):
    from codeloom.streaming import watch

    monkeypatch.setattr(watch, "COMPACT_EVERY", 2)
    store, feed = watched
    for seq in range(5):
        assert feed(("p", "a.py", seq, f"def f{seq}(): pass")) == {"a.py": (seq, [f"f{seq}"])}
    assert store.base.latest() == 2


def test_wide_rows_are_not_aggregated(watched):
    store, feed = watched
    feed(("p", "a.py", 1, "def a(): pass"))
    plan = store.current()._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Aggregate" in x and "functions" in x]


def folded_bytes(store, folder):
    """Bytes of the buckets that one fold has written."""
    base = os.path.join(store.root, "state", folder)
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet"))


def test_folds_write_what_arrived_and_delete_what_they_cover(spark, watched):
    store, feed = watched
    many = [("p", f"d{i}/f{i}.py", 1, f"def f{i}(): pass\n" * 20) for i in range(400)]
    feed(*many)
    store.compact()
    (first,) = os.listdir(os.path.join(store.root, "state"))
    whole = folded_bytes(store, first)
    state = {p: v for p, v in feed(("p", "d7/f7.py", 2, "def g(): pass")).items()}
    assert len(state) == 400 and state["d7/f7.py"] == (2, ["g"])
    store.compact()
    (second,) = set(os.listdir(os.path.join(store.root, "state"))) - {first}
    assert 0 < folded_bytes(store, second) < whole / 8
    buckets = [n for n in os.listdir(os.path.join(store.root, "state", second)) if n.startswith("bucket=")]
    assert len(buckets) == 1
    # what the state before the newest reads is still there, and goes with the next fold
    covered, folders = store._manifest(1)
    assert store._state(folders).count() == 400
    for seq in range(3, 9):
        assert feed(("p", "d7/f7.py", seq, f"def g{seq}(): pass"), ("p", "d8/f8.py", -seq, "def late(): pass")).items() >= {
            "d7/f7.py": (seq, [f"g{seq}"]), "d8/f8.py": (1, ["f8"] * 20),
        }.items()
        store.compact()
        assert len(os.listdir(os.path.join(store.root, "batches"))) <= 4
        assert len(os.listdir(os.path.join(store.root, "state"))) <= 5
        assert len([f for f in os.listdir(os.path.join(store.root, "base", "commits")) if f.startswith("v-")]) == 2
        assert len(os.listdir(os.path.join(store.root, "base", "manifest"))) == 2
    assert len(store.current().collect()) == 400
    # a batch that has been folded is not written again
    store.upsert(spark.createDataFrame([("p", "d9/f9.py", 99, None)], VERSION_SCHEMA), 0)
    assert store.current().count() == 400


def test_a_store_without_batches_is_empty(spark, tmp_path):
    store = WatchStore(spark, str(tmp_path / "none"))
    assert store.current().count() == 0 and "functions" in store.current().columns
    store.compact()
    assert store.base.latest() is None


def test_two_folds_at_once_do_not_mix(watched):
    from codeloom.sources.snapshot import Conflict

    store, feed = watched
    feed(("p", "a.py", 1, "def a(): pass"))
    store.compact()
    latest = store.base.latest
    feed(("p", "a.py", 2, "def b(): pass"))
    store.base.latest = lambda: None  # a fold that has not seen the first one
    with pytest.raises(Conflict):
        store.compact()
    store.base.latest = latest
    assert [f.name for r in store.current().collect() for f in r.functions] == ["b"]


def test_a_version_with_syntax_errors_outranks_the_one_before_it(watched):
    _, feed = watched
    assert feed(("p", "a.go", 1, "package a\nfunc F() {}\n")) == {"a.go": (1, ["F"])}
    assert feed(("p", "a.go", 2, "package a\nfunc F() {\n")) == {}
    assert feed(("p", "a.go", 3, "package a\nfunc G() {}\n")) == {"a.go": (3, ["G"])}


def test_outranked_versions_are_not_extracted(spark, watched):
    store, feed = watched
    rows = [("p", f"f{i}.py", 5, f"def f{i}(): pass") for i in range(6)]
    state = feed(*rows, ("p", "gone.py", 5, None), (None, "n.py", 5, "def n(): pass"))
    late = [("p", f"f{i}.py", 4, f"def old{i}(): pass") for i in range(6)]
    # most versions late; one equal, one newer, one new file, null keys and a null seq
    in_time = [("p", "f0.py", 5, "def g0(): pass"), ("p", "f1.py", 6, "def g1(): pass"), ("p", "new.py", 1, "def h(): pass")]
    odd = [(None, "n.py", 4, "def m(): pass"), ("p", "f2.py", None, "def g2(): pass")]
    got = feed(*late, *in_time, *odd, ("p", "gone.py", 4, "def gone(): pass"))
    assert got["f1.py"] == (6, ["g1"]) and got["new.py"] == (1, ["h"]) and got["n.py"] == state["n.py"]
    assert {p: got[p] for p in ("f2.py", "f3.py", "f4.py", "f5.py")} == {p: state[p] for p in ("f2.py", "f3.py", "f4.py", "f5.py")}
    assert "gone.py" not in got and got["f0.py"][0] == 5
    kept = lambda batch: sorted((r.path, r.seq or 0) for r in spark.read.parquet(f"{store.root}/batches/batch={batch}").collect())
    assert kept(1) == sorted([(r[1], r[2] or 0) for r in in_time + odd])
    # few late ones, against the folded state and the log; then none at all that is in time
    store.compact()
    more = [("p", f"m{i}.py", 1, f"def m{i}(): pass") for i in range(5)]
    got = feed(("p", "f1.py", 5, "def late(): pass"), *more)
    assert got["f1.py"] == (6, ["g1"]) and kept(2) == [(f"m{i}.py", 1) for i in range(5)]
    assert feed(("p", "m0.py", 0, "def late(): pass"), ("p", "f1.py", 1, None)) == got and kept(3) == []
    assert not os.listdir(os.path.join(store.root, "arrivals"))
