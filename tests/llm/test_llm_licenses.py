"""Licence notices, cosines and inheritance against plain Python."""

import math
import random
import re
from collections import Counter

from codeloom.llm import licenses

FILES = "path string, text string, license string, dir string"


def bag(text):
    lines = [x for x in (text or "").split("\n") if re.search(licenses.NOTICE_LINE, x)]
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), "\n".join(lines))
    return Counter(re.findall(licenses.TOKEN, folded))


def slow(files):
    bags = {}
    for path, text in files:
        if path is not None:
            bags.setdefault(path, Counter()).update(bag(text))
    full = {p: b for p, b in bags.items() if b}
    templates = {t.license: Counter(re.findall(licenses.TOKEN, t.text.lower())) for t in licenses.TEMPLATES}
    vocabulary = set().union(*templates.values())
    df = Counter(t for b in full.values() for t in b)
    idf = lambda t: math.log((1 + len(full)) / (1 + (df[t] if t in vocabulary else 1))) + 1
    dot = lambda a, b: sum(a[t] * b[t] * idf(t) ** 2 for t in a.keys() & b.keys())
    own = {}
    for path, b in full.items():
        best = max(((round(dot(b, t) / math.sqrt(dot(b, b) * dot(t, t)), 6), name) for name, t in templates.items()), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        if best[0] >= licenses.MIN_COSINE:
            own[path] = best
    up = lambda p: p.rpartition("/")[0]
    by_dir = {}
    for path, best in own.items():
        if re.search(licenses.LICENSE_FILE, path):
            by_dir[up(path)] = max(by_dir.get(up(path), best), best, key=lambda x: (x[0], [-ord(c) for c in x[1]]))
    out = {}
    for path in bags:
        if path in own:
            origin = "file" if re.search(licenses.LICENSE_FILE, path) else "header"
            out[path] = (own[path][1], own[path][0], origin, None)
            continue
        at = up(path)
        while at not in by_dir and at:
            at = up(at)
        out[path] = (by_dir[at][1], by_dir[at][0], "inherited", at) if at in by_dir else (None, None, "none", None)
    return out


def tree():
    rng = random.Random(3)
    texts = [t.text for t in licenses.TEMPLATES] + ["no notice here", "", None, "a copyright of nobody in particular", "All license of the GNU General Public License, version 3 and more words"]
    files = []
    for i in range(150):
        folder = "/".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        name = rng.choice(["LICENSE", "COPYING.txt", f"f{i}.py", f"g{i}.py", f"h{i}.js", "LICENSE_not.md"])
        body = f"first line {i}\n" + (rng.choice(texts) or "") + "\nlast é line"
        files.append(((folder + "/" if folder else "") + name, rng.choice([body, rng.choice(texts)])))
    files += [("a/x.py", None), ("a/x.py", None), (None, texts[0]), ("long/y.txt", "word " * 200_000 + "\n" + texts[0]), ("long/z/w.txt", "license " * 50_000)]
    return files


def scanned(spark, files):
    frame = spark.createDataFrame([(p, t, "x", "y") for p, t in files], FILES)
    return {r["path"]: (r["license"], r["cosine"], r["origin"], r["from_dir"]) for r in licenses.scan(frame).collect()}


def test_equals_plain_python(spark):
    got, wanted = scanned(spark, tree()), slow(tree())
    assert got.keys() == wanted.keys()
    assert {p: (x[0], *x[2:]) for p, x in got.items()} == {p: (x[0], *x[2:]) for p, x in wanted.items()}
    assert all(x[1] is None or abs(x[1] - wanted[p][1]) < 2e-6 for p, x in got.items())
    assert {x[2] for x in got.values()} >= {"file", "header", "inherited"} and {x[2] for x in scanned(spark, [("q/r", "s")]).values()} <= {"file", "header", "inherited", "none"}


def test_nearest_ancestor_wins(spark):
    mit, gpl = licenses.TEMPLATES[4].text, licenses.TEMPLATES[3].text
    got = scanned(spark, [("LICENSE", mit), ("a/b/COPYING", gpl), ("a/b/c/d.py", ""), ("a/e.py", ""), ("ab/b/f.py", gpl)])
    assert got["a/b/c/d.py"][::2] == ("GPL-3.0", "inherited") and got["a/b/c/d.py"][3] == "a/b"
    assert got["a/e.py"][::2] == ("MIT", "inherited") and got["a/e.py"][3] == ""
    assert got["ab/b/f.py"][2] == "header"


def test_empty_and_unlicensed_tables(spark):
    assert scanned(spark, []) == {}
    assert scanned(spark, [("a/b", "text"), ("c", None)]) == {"a/b": (None, None, "none", None), "c": (None, None, "none", None)}


def test_the_plan_is_native(spark):
    frame = spark.createDataFrame([("a/LICENSE", "MIT license", "", "")], FILES)
    plan = licenses.scan(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
