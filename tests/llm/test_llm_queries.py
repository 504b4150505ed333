"""Registered corpus queries against their SQL, and the pipeline against its parts."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from codeloom.llm import decontam, quality
from codeloom.llm.queries import CHECKS, QUERIES
from codeloom.llm.sql_checks import CHECKS as SQL
from compare import connect, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert CHECKS == SQL and set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, connect(SF), name, QUERIES[name], SQL[name], SF) == ""


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_pipeline_stages_on_the_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, [docs]
    for _, work in corpus_pipeline.STAGES:
        out = work(spark, kept[-1], SF)
        path = f"/tmp/codeloom-test-{os.getpid()}-{len(kept)}"
        out.write.mode("overwrite").parquet(path)
        kept.append(spark.read.parquet(path))
    assert all(k.columns == names for k in kept[:-1])
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    # quality: nearly every labelled document goes by its label
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(i in ids[1]) == (labels[i] == 1) for i in ids[0] if i in labels]
    assert sum(right) >= 0.95 * len(right)
    # near copies: of similar texts one stays, and what goes has a similar text
    sets = {i: shingles(text[i]) for i in ids[1]}
    similar = {i: {j for j in sets if i != j and sets[i] & sets[j] and jaccard(sets[i], sets[j]) >= 0.5} for i in sets}
    assert all(similar[i] for i in ids[1] - ids[2])
    close = [(i, j) for i in ids[2] for j in similar[i] & ids[2] if jaccard(sets[i], sets[j]) >= 0.8]
    assert not close
    assert len({text[i] for i in ids[2]}) == len(ids[2])
    # benchmark passages: none is left, and only they go
    windows = {w["words"] for w in decontam.item_windows(spark.read.parquet(f"{SF}/benchmark.parquet"), 10).collect()}
    for i in ids[2]:
        w = decontam.words_of((text[i] or "").encode())
        found = any(b" ".join(w[k : k + 10]) in windows for k in range(len(w)))
        assert found == (i not in ids[3])
    # packing: every kept document is there as a whole
    length = {r["doc_id"]: (r["n"], r["t"]) for r in kept[4].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", "n", "t").collect()}
    assert set(length) == ids[3] and all(n == t for n, t in length.values())


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, 0), (3, "word " * 100_000, "en", "s", 5)]
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame([], DOCS)):
        for name, work in corpus_pipeline.STAGES[:-1]:
            out = work(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == (docs.count() and out_pieces(docs))
    assert quality.THRESHOLD == 0.7


def out_pieces(docs):
    """Pieces of the odd rows: all of their tokens, in whatever cuts."""
    from codeloom.llm import packing
    from codeloom.llm.queries import tokenizer_path

    return packing.pack(docs, tokenizer_path()).count()
