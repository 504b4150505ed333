"""The quality classifier: ranking, threshold and odd inputs."""

import os
import random
import zlib

import numpy as np
import pytest

from codeloom.llm import quality
from codeloom.llm.queries import op1_quality_classifier

DOCS = "doc_id long, text string, score string, x int"
SF = "/root/testdata/sf0.01"


def text(rng, good):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 80))]
    return " ".join(words) + "." if good else "### ".join(words) if rng.random() < 0.5 else " | ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    good = {i: rng.random() < 0.8 for i in range(400)}
    docs = [(i, text(rng, g), "x", 1) for i, g in good.items()]
    labels = [(i, int(g)) for i, g in good.items()] + [(0, 1 - good[0]), (1, None), (999, 1), (None, 0)]
    return good, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_rows_are_ranked_and_cut(spark, tables):
    good, docs, labels = tables
    model = quality.train(docs, labels)
    out = {r["id"]: r["score"] for r in quality.scores(docs, model).collect()}
    held = [i for i in good if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(0 <= s <= 1 for s in out.values())
    assert np.mean([(out[i] >= quality.THRESHOLD) == good[i] for i in held]) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in out.items() if s >= quality.THRESHOLD}


def test_held_out_labels_are_never_seen(spark, tables):
    good, docs, labels = tables
    turned = labels.rdd.map(
        lambda r: (r[0], 1 - r[1] if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2 else r[1])
    ).toDF(labels.schema)
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert np.allclose(a.weights, b.weights) and a.level == b.level


def test_pairs_teach_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    good = x[:, 0] + 0.1 * rng.normal(size=500) > -1
    model = quality.fit(x, good, float((~good).mean()))
    score = model.score(x)
    assert np.mean(score[good][:, None] > score[~good][None]) > 0.97
    # the quantile at the share of bad rows lies on the threshold
    assert abs((score < quality.THRESHOLD).mean() - (~good).mean()) < 0.01


def test_odd_texts_and_empty_tables(spark, tables):
    _, docs, labels = tables
    odd = [(None, None, "", 0), (1, "", "", 0), (1, "", "", 0), (2, "\x00\x01", "", 0), (3, "é" * 300_000, "", 0), (4, "a b " * 200_000, "", 0)]
    table = spark.createDataFrame(odd, DOCS)
    out = quality.scores(table, quality.train(docs, labels)).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
    # nothing to learn from: nothing is rejected
    for d, t in ((table, labels.limit(0)), (table.limit(0), labels), (docs, labels.filter("quality = 1"))):
        model = quality.train(d, t)
        assert quality.keep_good(table, model).count() == 6
    assert quality.scores(table.limit(0), quality.train(docs, labels)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy_on_the_given_tables(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op1_quality_classifier(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95


def test_texts_of_one_id_give_one_model(spark):
    rows = [(i, ("good words in a plain sentence. " if i % 2 else "$$ !! ") * (1 + i % 5), "en", "s", 0) for i in range(60)]
    rows += [(i, "another text of the same id " * (i % 7 + 1), "en", "s", 0) for i in range(0, 60, 3)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    found = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, schema).repartition(3)
        model = quality.train(docs, labels)
        found.append(sorted((r["id"], r["score"]) for r in quality.scores(docs, model).collect()))
    assert found[0] == found[1]
