"""Whitening against numpy and against exact small cases."""

import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from codeloom.llm import whitening as w
from codeloom.llm.queries import QUERIES

VECS = "vec_id long, embedding array<float>, component int, n string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in enumerate(vectors)], VECS)


def determinant(matrix):
    m, out = [[Fraction(v) for v in row] for row in matrix], Fraction(1)
    for k in range(len(m)):
        at = next((i for i in range(k, len(m)) if m[i][k]), None)
        if at is None:
            return 0
        if at != k:
            m[k], m[at], out = m[at], m[k], -out
        out *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [a - f * b for a, b in zip(m[i], m[k], strict=True)]
    return out


def gram(rng, d, rank, size):
    rows = [[rng.randint(-size, size) for _ in range(d)] for _ in range(rank)]
    return [[sum(r[i] * r[j] for r in rows) for j in range(d)] for i in range(d)]


def test_polynomial_is_exact(spark):
    rng = random.Random(2)
    for d, rank, size in ((1, 1, 9), (2, 1, 9), (4, 4, 10**9), (6, 3, 10**6), (7, 9, 3), (5, 0, 1)):
        a = gram(rng, d, rank, size)
        if d >= 4:  # zeros where the reduction looks for a pivot
            for i in range(2, d):
                a[0][i] = a[i][0] = 0
            a[0][0] += 5 * size * size * d
        poly = w.characteristic_polynomial(spark, a)
        assert poly[0] == 1 and len(poly) == d + 1
        for x in (0, 1, -3, 10**7):
            value = sum(c * x ** (d - k) for k, c in enumerate(poly))
            assert value == determinant([[x * (i == j) - a[i][j] for j in range(d)] for i in range(d)])


def product(roots):
    poly = [1]
    for r in roots:
        poly = [a - r * b for a, b in zip([*poly, 0], [0, *poly], strict=True)]
    return poly


def test_roots_and_multiplicities():
    assert w.largest_roots(product([5, 3, 3, 1, 0]), 4, 0) == [(5, 1), (3, 2), (1, 1)]
    assert w.largest_roots(product([5, 3, 3, 1, 0]), 4, 10) == [(5 << 10, 1), (3 << 10, 2), (1 << 10, 1)]
    assert w.largest_roots(product([0, 0]), 4, 10) == [] and w.largest_roots([1], 4, 10) == []
    assert w.largest_roots(product([7]), 4, 3) == [(56, 1)]
    # roots that a double cannot tell apart
    near = [10**20 + 1, 10**20, 10**20 - 1, 4]
    assert [r for r, _ in w.largest_roots(product(near), 4, 0)] == near
    rng = random.Random(5)
    for _ in range(30):
        roots = sorted((rng.randint(0, 40) for _ in range(8)), reverse=True)
        found = w.largest_roots(product(roots), 8, 6)
        assert [r for r, m in found for _ in range(m)] == [r << 6 for r in roots if r]


def test_null_vectors_of_equal_roots():
    a = [[2, 0, 0], [0, 5, 0], [0, 0, 5]]
    u, v = w.null_vectors(a, Decimal(5), 2)
    assert abs(sum(x * y for x, y in zip(u, v, strict=True))) < Decimal(10) ** -80
    for x in (u, v):
        assert abs(x[0]) < Decimal(10) ** -80 and abs(sum(c * c for c in x) - 1) < Decimal(10) ** -80


def expected(x, top=4):
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    values, vectors = values[::-1], vectors[:, ::-1]
    return (x - fit.mean(axis=0)) @ vectors[:, :top] / np.sqrt(values[:top]), values / values.sum()


@pytest.mark.parametrize("offset", [0.0, 1000.0])
def test_equals_numpy(spark, offset):
    rng = np.random.default_rng(11)
    data = (rng.normal(size=(500, 6)) * [5, 3, 2, 1, 0.5, 0.1] + offset).astype(np.float32)
    data = np.concatenate([data, data[:50], data[:50]])  # copies count once in the fit
    out = w.whiten(table(spark, data.tolist()).repartition(5)).collect()
    assert len(out) == 4 * len(data)
    x = np.floor(256 * data.astype(float)).astype(np.int64)
    want, share = expected(x)
    got = np.zeros((len(data), 4))
    fit = np.unique(x, axis=0)
    deviation = {i: sum((len(fit) * int(a) - int(s)) ** 2 for a, s in zip(row, fit.sum(axis=0), strict=True)) for i, row in enumerate(x)}
    for r in out:
        got[r["id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == len(fit) and int(r["deviation"]) == deviation[r["id"]]
        assert abs(r["explained"] - share[r["component"] - 1]) < 1e-9 and r["identity_error"] < 1e-9
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-7


def test_odd_vectors(spark):
    rows = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [], [1.0], [-0.0, 0.0], [2.0, 1.0], [2.0, 1.0]]
    out = w.whiten(table(spark, rows)).collect()
    # two dimensions; read as (0,0), (1,0), (0,0), (2,1), (2,1)
    assert sorted((r["id"], r["component"]) for r in out) == [(i, c) for i in range(4, 9) for c in (1, 2)]
    assert {r["n"] for r in out} == {3}
    by_id = {(r["id"], r["component"]): r["whitened"] for r in out}
    assert by_id[4, 1] == by_id[6, 1] and by_id[7, 2] == by_id[8, 2]
    assert abs(sum(r["explained"] for r in out if r["id"] == 4) - 1) < 1e-12


def test_directions_without_variance(spark):
    flat = w.whiten(table(spark, [[1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [3.0, 6.0, 9.0]])).collect()
    assert len(flat) == 9
    for r in flat:
        assert (r["whitened"] is None) == (r["component"] > 1)
        assert r["explained"] == pytest.approx(1.0 if r["component"] == 1 else 0.0)
    alone = w.whiten(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(alone) == 6 and all(r["whitened"] is None and r["explained"] is None and r["n"] == 1 for r in alone)
    assert all(r["deviation"] == "0" and r["identity_error"] is None for r in alone)
    empty = table(spark, [[1.0]]).limit(0)
    assert w.whiten(empty).count() == 0 and w.whiten(table(spark, [[], None])).count() == 0


def test_entries_beyond_64_bits_of_product(spark):
    vectors = [[3e15, 1.0], [-3e15, 2.0], [1e15, -5.0], [2.0**70, 0.0], [-(2.0**70), 1.0]]
    out = w.whiten(table(spark, vectors)).collect()
    x = [[max(-(1 << 63), min((1 << 63) - 1, int(np.float32(c).astype(float) * 256 // 1))) for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r in out:
        assert int(r["deviation"]) == sum((5 * a - s) ** 2 for a, s in zip(x[r["id"]], sums, strict=True))
        assert r["identity_error"] < 1e-9


def test_equal_eigenvalues(spark):
    vectors = [[s * (i == j) for j in range(5)] for i in range(5) for s in (1.0, -1.0)]
    out = w.whiten(table(spark, vectors)).collect()
    assert len(out) == 40 and all(r["identity_error"] < 1e-12 and abs(r["explained"] - 0.2) < 1e-15 for r in out)


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op11_embedding_whitening"](spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.floor(256 * np.array([r["embedding"] for r in rows], float)).astype(np.int64)
    want, share = expected(x)
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    made = np.zeros((len(rows), 4))
    for r in got.collect():
        made[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["identity_error"] <= 1e-4 and abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-6
    assert np.abs(np.abs(made) - np.abs(want)).max() < 1e-9
