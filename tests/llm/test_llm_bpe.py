"""Ids of the segment tree against the tokenizer library, and the way back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from codeloom.llm import bpe
from codeloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
DOCS = "doc_id long, text string, ids string, decoded int"
ODD = [
    "", " ", "   ", "a", " a b", "foo   bar", "a\n b", "don't, we'll. It's", "a <|endoftext|> b", "é, ü! ß.", "\x85  a \x1c c",
    "naïve... (x) [y]!", "tab\tin word", "五六, Ⅷ!", "end \n\n", "\U0001f600     x", "\x00\x01", "́́", "ﬁ ﷽ ﻿",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def ids_of(text):
    return np.frombuffer(bpe.Encoder.of(PATH, PATTERN).encode(text.encode()), "<u4").tolist()


def texts():
    rng = random.Random(13)
    some = ["".join(rng.choice("aB é'.,\n\t 19ßthe  　\x85\x1c五ing") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    long = ["a" * 50_000, "ab" * 20_000, " " * 5_000 + "x", "".join(rng.choice("abcdefgh") for _ in range(50_000)), "é" * 9_999]
    return ODD + some + long


def test_ids_are_the_librarys(library):
    for text in texts():
        assert ids_of(text) == library.encode_ordinary(text), text[:50]


def test_every_character_is_cut_as_by_the_library(library):
    points = [p for p in range(0x11000) if not 0xD800 <= p < 0xE000]
    for p in points:
        text = f"a{chr(p)}b {chr(p)} 1{chr(p)}2"
        assert ids_of(text) == library.encode_ordinary(text), hex(p)


def by_scanning(word, ranks):
    """The definition: merge the leftmost pair of the lowest rank until there is none."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges_follow_the_definition():
    rng = random.Random(3)
    ranks = {bytes([b]): b for b in range(97, 101)}
    for rank in range(200, 260):  # a vocabulary of pairs of earlier tokens, ranked at random
        a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
        ranks.setdefault(a + b, rank)
    longest = max(map(len, ranks))
    for _ in range(3000):
        word = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 40)))
        assert bpe.merge(word, ranks, longest) == by_scanning(word, ranks)


def test_forgotten_words_are_encoded_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 3)
    encoder = bpe.Encoder(PATH, PATTERN)
    text = "some xyzzy words qwertz again some xyzzy words plugh"
    assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == library.encode_ordinary(text)
    assert len(encoder) <= 3


def test_long_texts_are_cut_where_words_start(library, monkeypatch):
    monkeypatch.setattr(bpe, "PART_CHARS", 1)
    for text in [*texts()[:1500], " a  b c\n d \x85 e f", "it 's 5 's", "a" * 50 + " " * 50]:
        assert ids_of(text) == library.encode_ordinary(text), text


def test_round_trip_and_odd_rows(spark):
    rows = [(1, None, "x", 1), (1, None, "x", 1), (None, "null id", None, None), *((10 + i, t, "x", 2) for i, t in enumerate(texts()[:60]))]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH).collect()
    assert len(out) == len(rows) and out[0].__fields__ == ["id", "ids", "decoded"]
    want = {(i, (t or "").encode()) for i, t, _, _ in rows}
    assert {(r["id"], bytes(r["decoded"])) for r in out} == want
    empty = bpe.digests(docs.limit(0), PATH, PATTERN)
    assert empty.count() == 0
    nulls = spark.createDataFrame([(1, None)], "k int, ids binary")
    assert bpe.decode(nulls, PATH).first()["decoded"] is None


def test_unknown_ids_are_refused(spark):
    bad = spark.createDataFrame([(bytearray(b"\xff\xff\xff\x00"),)], "ids binary")
    with pytest.raises(Exception, match="IndexError"):
        bpe.decode(bad, PATH).collect()


def test_query_on_the_given_table(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op13_byte_bpe"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, row = library.encode_ordinary(d["text"] or ""), got[d["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_words_met_again_outlive_a_full_memory(monkeypatch):
    calls = []
    plain = bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda word, *rest: calls.append(word) or plain(word, *rest))
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 8)
    encoder = bpe.Encoder(PATH, PATTERN)
    for i in range(40):
        encoder.encode(f"qzxjvk xq{chr(97 + i % 26)}{chr(97 + i // 26)}zxq".encode())
        assert len(encoder) + len(encoder.older) <= 8
    assert calls.count(b"qzxjvk") == 1 and len(calls) > 20
