"""Benchmark windows against a search at every place."""

import hashlib
import random
import re

from codeloom.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, id string, n_words int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), sorted(found), digest))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["a", "b", "Ça", "d1", "E"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 4, 7, 12]))) for i in range(30)] + [(99, None), (98, "...!"), (97, "A b"), (96, "a, B")]
    items.append((10, items[12][1]))  # an item in two rows
    docs = [(i, text(rng.choice([0, 1, 3, 30, 200]))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "a " * 60_000), (103, "x" * 100_000), (7, "once more"), (None, text(20))]
    return docs, items


def report(spark, docs, items, **how):
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.Decontamination(table, bench, **how).report(table).collect()
    return sorted(((r["id"], r["n_words"], r["n_hit"], r["item_ids"], r["items_sha256"]) for r in out), key=repr)


def test_equals_brute_force(spark):
    docs, items = corpus()
    assert report(spark, docs, items, size=5) == slow(docs, items, 5)


def test_blocks_of_windows_give_the_same(spark):
    docs, items = corpus()
    assert report(spark, docs, items, size=4, block_windows=9) == slow(docs, items, 4)


def test_many_candidates_at_one_place(monkeypatch, spark):
    monkeypatch.setattr(decontam, "_CANDIDATES", 3)
    docs, items = corpus()
    assert report(spark, docs, items, size=3) == slow(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus()
    assert report(spark, [], items) == []
    assert report(spark, docs, []) == slow(docs, [], 10)
    assert report(spark, docs, [(1, None), (2, "--")]) == slow(docs, [], 10)


def test_clean_keeps_the_other_rows_whole(spark):
    rows = [(1, "one two three four five", "x", 1), (2, "one two, three; FOUR five", "x", 2), (3, None, None, None), (3, "", "y", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    clean = decontam.Decontamination(docs, bench).clean(docs)
    assert clean.schema == docs.schema
    assert clean.count() == 2 and {r["doc_id"] for r in clean.collect()} == {3}


def test_windows_of_items_without_an_id_are_hit(spark):
    items = [(None, "one two three"), (None, "six seven"), (4, "six seven"), (5, "nothing here")]
    docs = [(1, "zero one two three four"), (2, "six seven"), (3, "one two four")]
    got = {r[0]: r[2:4] for r in report(spark, docs, items)}
    assert got == {1: (3, []), 2: (2, ["4"]), 3: (0, [])}
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [r["doc_id"] for r in decontam.Decontamination(table, bench).clean(table).collect()] == [3]
