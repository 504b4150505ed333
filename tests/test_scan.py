import fnmatch

import pyarrow as pa
import pytest

from codeloom.config import AnalysisConfig
from codeloom.functions import paths
from codeloom.operators import scan
from codeloom.sources.tree import list_tree, scan_table, scan_tree, walk_tree


def kept(files, names, config=AnalysisConfig()):
    table = files({n: "" for n in names})
    return {r.path for r in scan.ignore_filter(table, config).collect()}


def test_default_ignores(files):
    dropped = [
        "node_modules/x.js", ".git/config.py", "a/dist/b.ts", "vendor/v.go", "x/__pycache__/y.py",
        "a/__init__.py", "manage.py", "web/app.min.js", "a.min.css", "poetry.lock",
        "app/migrations/0001_initial.py", "env/a.py", ".next/a.js", "codeloom/CONTEXT.py",
    ]
    stay = ["src/a.py", "main.go", "internal/parser/p.go", "distribution/a.ts", "min.js",
            "001_x.py", "a/environment.py", "x/00012_a.py"]
    assert kept(files, dropped + stay) == set(stay)


@pytest.mark.parametrize("glob", ["*.py", "a?c", "[0-9]x*", "[^a]b", "a\\*b", "**", "a*b*c", "[a-c-e", "[]a]", "x[", "[b-a]"])
def test_globs(files, glob):
    names = ["a.py", "abc", "5xyz", "bb", "ab", "a*b", "axxbyyc", "x", "x[", "[]a]", "[a-c-e"]
    valid = paths.glob_regex(glob) is not None
    expected = {
        n for n in names
        if n == glob or (valid and _simple(glob, n))
    }
    assert set(names) - kept(files, names, AnalysisConfig(ignore=(glob,))) == expected


def _simple(glob, name):
    if "\\" in glob:
        return name == "a*b"
    if glob == "[b-a]":
        return False
    return fnmatch.fnmatchcase(name, glob.replace("[^", "[!"))


def test_languages(files):
    expected = {
        "a.go": "Go", "b.js": "JavaScript", "c.jsx": "JavaScript", "d.mjs": "JavaScript",
        "e.cjs": "JavaScript", "f.ts": "TypeScript", "g.TSX": "TypeScript", "h.PY": "Python",
        "i.dart": "Dart", ".py": "Python", "x.d/k.d.ts": "TypeScript",
    }
    names = [*expected, "README.md", "Makefile", "a.go/b", "x.py.txt", "trailing."]
    rows = scan.language_classify(files({n: "" for n in names})).collect()
    assert {r.path: r.language for r in rows} == expected


def test_lines(files):
    rows = scan.source_lines(files({"a.py": "x\n\ny\r\n", "b.py": ""})).collect()
    assert sorted((r.path, r.line, r.txt) for r in rows) == [
        ("a.py", 1, "x"), ("a.py", 2, ""), ("a.py", 3, "y\r"), ("a.py", 4, ""), ("b.py", 1, ""),
    ]


def test_tree(spark, tmp_path):
    for name, data in {
        "one/main.go": b"package main\n", "one/node_modules/dep.js": b"x", "one/sub dir/a+b%20.js": b"y",
        "two/bad.py": b"x = '\xff'\n",
    }.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    rows = scan_tree(spark, str(tmp_path)).collect()
    assert {(r.project, r.path): r.content for r in rows} == {
        ("one", "main.go"): "package main\n", ("one", "node_modules/dep.js"): "x",
        ("one", "sub dir/a+b%20.js"): "y", ("two", "bad.py"): "x = '�'\n",
    }
    single = scan.source_files(scan_tree(spark, str(tmp_path / "one"), project="p"))
    assert sorted(r.path for r in single.collect()) == ["main.go", "sub dir/a+b%20.js"]
    scan_tree(spark, str(tmp_path)).write.parquet(str(tmp_path / "table"))
    assert scan_table(spark, str(tmp_path / "table")).count() == 4


def grow(root, files):
    for name, data in files.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)


def test_walk_equals_filtered_scan(spark, tmp_path):
    grow(tmp_path, {
        "one/main.go": b"package main\n", "one/node_modules/dep.js": b"x", "one/sub dir/a+b%20.js": b"y",
        "one/x/build/y.py": b"", "one/x/deep/er/z.dart": b"enum A {}", "one/x/app.min.js": b"", "one/README.md": b"",
        "two/bad.py": b"x = '\xff'\n", "two/vendor": b"a file", "build/in.ts": b"type A = 1;", "stray.go": b"",
        "two/\u00e9/\u4e94.py": b"import os\n",
    })
    (tmp_path / "two" / "loop").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "two" / "linked.py").symlink_to(tmp_path / "two" / "bad.py")
    (tmp_path / "two" / "gone.py").symlink_to(tmp_path / "nowhere")
    walked = {(r.project, r.path): r.content for r in walk_tree(spark, str(tmp_path)).collect()}
    assert set(walked) == {
        ("one", "main.go"), ("one", "sub dir/a+b%20.js"), ("one", "x/deep/er/z.dart"), ("two", "bad.py"),
        ("two", "linked.py"), ("two", "\u00e9/\u4e94.py"), ("build", "in.ts"),
    }
    (tmp_path / "two" / "loop").unlink()
    (tmp_path / "two" / "linked.py").unlink()
    (tmp_path / "two" / "gone.py").unlink()
    scanned = scan.source_files(scan_tree(spark, str(tmp_path))).collect()
    assert {(r.project, r.path): r.content for r in scanned} == {k: v for k, v in walked.items() if k[1] != "linked.py"}
    # a project whose own directory has an ignored name is still read
    single = walk_tree(spark, f"file://{tmp_path}/build", project="p").collect()
    assert [tuple(r) for r in single] == [("p", "in.ts", "type A = 1;")]


def test_walk_lists_nothing_below_ignored_directories(spark, tmp_path):
    grow(tmp_path, {"src/a.py": b"", "src/lib/b.py": b""})
    for d in range(100):
        folder = tmp_path / "src" / "node_modules" / f"dep{d}"
        folder.mkdir(parents=True)
        for i in range(100):
            (folder / f"f{i}.js").touch()
    listed = {r.path: (r.is_dir, r.kept) for r in list_tree(spark, str(tmp_path), project="p").collect()}
    assert listed == {
        "src": (True, True), "src/a.py": (False, True), "src/lib": (True, True), "src/lib/b.py": (False, True),
        "src/node_modules": (True, False),
    }
    everything = AnalysisConfig(ignore=())
    assert list_tree(spark, str(tmp_path), everything, "p").filter("not is_dir").count() == 10_002


def test_walk_of_empty_trees(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert walk_tree(spark, str(tmp_path)).count() == 0
    assert walk_tree(spark, str(tmp_path / "empty"), project="p").count() == 0
    assert walk_tree(spark, str(tmp_path / "missing"), project="p").count() == 0


def test_walk_through_a_file_system_with_a_scheme(spark, tmp_path, monkeypatch):
    """The branch for other stores, by a local file system that is given for a scheme."""
    from pyarrow import fs

    from codeloom.sources import tree

    grow(tmp_path, {"a.py": b"x", "d/b.go": b"package b"})
    monkeypatch.setattr(tree, "_store", lambda location: (fs.LocalFileSystem(), location.removeprefix("store://host")))
    root = f"store://host{tmp_path}"
    found = {name: (at, is_dir) for name, at, is_dir, _ in tree._entries(root)}
    assert found == {"a.py": (f"{root}/a.py", False), "d": (f"{root}/d", True)}
    rows = pa.RecordBatch.from_pylist([{"project": "p", "path": n, "location": f"{root}/{n}".encode()} for n in ("a.py", "none.py", "d/b.go")])
    got = [r for b in tree._contents(iter([rows])) for r in b.to_pylist()]
    assert [(r["path"], r["content"]) for r in got] == [("a.py", b"x"), ("d/b.go", b"package b")]
