"""Packed sequences give back every token, and costs are even."""

import random
import statistics
import zlib

import numpy as np
import pytest

from codeloom.llm import packing
from codeloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, ids string, length int"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


ODD = [
    "", " ", "   ", "a", " a b", "foo   bar", "a\n b", "don't, we'll. It's", "a <|endoftext|> b", "é, ü! ß.", "\x85  a \x1c c",
    "naïve... (x) [y]!", "tab\tin word", "五六, Ⅷ!", "end \n\n", "\U0001f600     x",
]


def test_ids_are_the_tokenizers(tokenizer):
    encoder = packing.Encoder.of(tokenizer_path())
    assert encoder.ranked is not None
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("aB é'.,\n\t 19ßthe ") for _ in range(200)) for _ in range(200)] + ["ab" * 40_000]
    for text in texts:
        own = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert own == tokenizer.encode(text, add_special_tokens=False).ids


def check(lengths, capacity):
    pieces = packing.assign(lengths, capacity)
    docs, sequences = {}, {}
    for doc, start, length, sequence, offset in pieces:
        assert length > 0
        docs.setdefault(doc, []).append((start, length))
        sequences.setdefault(sequence, []).append((offset, length))

    def gapless(parts):
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
        return end

    assert {d: gapless(p) for d, p in docs.items()} == {i: n for i, n in enumerate(lengths) if n}
    sizes = {s: gapless(p) for s, p in sequences.items()}
    assert sorted(sizes) == list(range(len(sizes)))
    # no padding: full, or a power of two, and less than one sequence in all of those
    partial = [n for n in sizes.values() if n != capacity]
    assert all(n & (n - 1) == 0 for n in partial) and sum(partial) < capacity
    return pieces


@pytest.mark.parametrize("capacity", [16, 100, 2048])
def test_every_token_is_in_one_piece(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 2, 50, 700):
        check([rng.choice([1, 2, capacity - 1, capacity, capacity + 1, rng.randint(1, 3 * capacity)]) for _ in range(n)], capacity)
    check([1] * 1000, capacity)
    check([capacity // 2 + 1] * 99, capacity)


def test_the_cheapest_sequence_with_room_is_found_wherever_it_is():
    """Against a search of all sequences, also where very many cheap ones are too full."""
    rng = random.Random(9)
    for lengths in ([60] * 300 + [3] * 900 + [41] * 100, [rng.choice([1, 2, 30, 55, 63]) for _ in range(800)], [40] * 200 + [24] * 200):
        rests = sorted((-n, i) for i, n in enumerate(lengths))
        bins = sum(lengths) // 64
        used, spent, whole = [0] * bins, [0.0] * bins, {}
        for negative, doc in rests:
            fits = [(spent[b], b) for b in range(bins) if used[b] - negative <= 64]
            if fits:
                _, b = min(fits)
                whole[doc], used[b], spent[b] = b, used[b] - negative, spent[b] + packing.cost(-negative)
        pieces = check(lengths, 64)
        cut = {d for d, start, n, *_ in pieces if n < lengths[d]}
        assert {d for d, start, n, *_ in pieces if n == lengths[d]} >= set(whole)
        assert not cut & set(whole)
        assert all(sequence == whole[d] for d, _, n, sequence, _ in pieces if d in whole)


def test_costs_are_even():
    rng = random.Random(8)
    lengths = [min(700, int(rng.lognormvariate(5, 1)) + 1) for _ in range(5000)]
    cost, size = {}, {}
    for _, _, length, sequence, _ in check(lengths, 2048):
        cost[sequence] = cost.get(sequence, 0) + packing.cost(length)
        size[sequence] = size.get(sequence, 0) + length
    full = [cost[s] for s in cost if size[s] == 2048]
    # whole documents into the first sequence with room
    room, plain = [], []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(room) if r >= n), None)
        if at is None:
            room.append(2048)
            plain.append(0.0)
            at = len(room) - 1
        room[at] -= n
        plain[at] += packing.cost(n)
    assert statistics.pstdev(full) < 0.2 * statistics.pstdev(plain)


def test_round_trip(spark, tokenizer):
    texts = dict(enumerate([*ODD, None, "long text " * 30_000, *["same text here"] * 5]))
    rows = [(i, t, "x", 1) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    out = packing.pack(docs, tokenizer_path(), block_tokens=5000)
    rows = out.withColumn("crc", packing.ids_crc32()).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["start"])):
        own = got.setdefault(r["id"], [])
        assert r["start"] == len(own)
        own += np.frombuffer(r["ids"], "<u4").tolist()
        assert r["crc"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4
    wanted = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    assert got == wanted
    assert all(r["doc_tokens"] == len(wanted[r["id"]]) for r in rows)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        assert sum(n for _, n in parts) == max(o + n for o, n in parts) <= 2048


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b", "", 0), (1, None, "", 0), (1, None, "", 0)], DOCS)
    out = packing.pack(docs, tokenizer_path()).collect()
    # two documents of the end id alone, and one of three tokens
    assert sorted((r["id"] or 0, r["doc_tokens"]) for r in out if r["start"] == 0) == [(0, 3), (1, 1), (1, 1)]
    assert sum(r["length"] for r in out) == 5
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0
