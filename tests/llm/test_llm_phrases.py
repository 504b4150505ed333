"""Phrase mining against counting every phrase by hand; its SQL is tested with the queries."""

import random
from collections import Counter

import pytest

from codeloom.llm import phrases

DOCS = "doc_id long, text string, lang string, phrase string, rank int"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def mined(rows, least, covered, top, size):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang, piece = lang if lang is not None else "und", ""
        for c in fold(text or "") + "\n":
            if c not in ".,;:!?\n\x0b\x0c\r":
                piece += c
                continue
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            total[lang] += len(words)
            for i in range(len(words)):
                for n in range(1, size + 1):
                    if i + n <= len(words):
                        f[lang, tuple(words[i : i + n])] += 1
            piece = ""
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in found.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                if 100 * a >= covered * f[lang, p[i : i + n]]:
                    gone.add((lang, p[i : i + n]))
    out = {}
    for (lang, p), a in found.items():
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if (lang, p) not in gone:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {
        (lang, rank, p.decode(), -a, left, right, total[lang], -s)
        for lang, own in out.items()
        for rank, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)
    }


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a\tb", "New", "york", "city", "é", "É", "x y", "ß", "zz", "ﬁ", "\U0001f600"]
    marks = [" ", "  ", "\t", ". ", ", ", "\n", "\r\n", "; ", " the ", " new york ", " New York City ", "\x0b"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 30)))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), rng.choice([text, text, text, None, ""])))
    return rows


@pytest.mark.parametrize("slots", [None, 64])
@pytest.mark.parametrize("size", [2, 4])
def test_equals_counting_by_hand(spark, slots, size):
    rows = corpus((slots or 1) + size)
    docs = spark.createDataFrame([(i, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)], DOCS).repartition(4)
    for least, covered, top in ((3, 80, 2000), (2, 100, 5)):
        got = phrases.mine(docs, least=least, covered=covered, top=top, size=size, slots=slots)
        assert {tuple(r) for r in got.collect()} == mined(rows, least, covered, top, size)


def test_rare_phrases_shorten_windows_and_frequent_ones_never(spark):
    texts = spark.createDataFrame([("en", bytearray(b"a b c d, a b c. x"))] * 5, "lang string, text binary")
    slots = phrases.MIN_SLOTS
    pairs = phrases.frequent_slots(texts, 10, slots, [])
    assert len(pairs) == slots // 8
    triples = phrases.frequent_slots(texts, 10, slots, [pairs])
    got = phrases.word_rows(texts, [pairs, triples], slots).first()
    assert got["words"] == ["a", "b", "c", None, "a", "b", "c", None]
    assert got["lengths"] == [3, 2, 1, 0, 3, 2, 1, 0]
    rows = phrases.windows(phrases.word_rows(texts.limit(1), [pairs, triples], slots))
    assert tuple(rows.first()) == ("en", "a", "b", "c", None)


def test_long_texts_held_in_parts(spark):
    rows = [("en", "one two three. " * 200_000), ("en", "x" * 3_000_000), ("en", "y z " * 400_000)]
    docs = spark.createDataFrame([(i, t, lang, "x", 1) for i, (lang, t) in enumerate(rows)], DOCS)
    got = {(r["phrase"], r["a"], r["l"], r["r"], r["n"]) for r in phrases.mine(docs).collect()}
    n = 600_000 + 1 + 800_000
    assert got == {
        ("one two three", 200_000, 200_000, 200_000, n),
        ("y z y z", 399_999, 400_000, 400_000, n),
        ("z y z y", 399_998, 400_000, 399_999, n),
    }


def test_no_phrases(spark):
    docs = spark.createDataFrame([(1, None, None, "x", 1), (2, "", "en", "x", 1), (3, "a b", "en", "x", 1)], DOCS)
    assert phrases.mine(docs).count() == 0 and phrases.mine(docs.limit(0)).count() == 0


def test_counts_beyond_64_bits_of_product(spark):
    big = 9_000_000_000_000_000
    found = spark.createDataFrame(
        [("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big)], "lang string, m int, phrase string, f long"
    )
    row = phrases._scores(found, 4).first()
    assert row["score"] == 2_000_000 * big // (2 * big + 1)
