"""Links and components of embeddings against all pairs, and recall of the graphs."""

import numpy as np
import pytest

from codeloom.llm import hnsw

VECTORS = "vec_id long, embedding array<float>, label int, id string, n int"


def slow(rows):
    """``{row number: (n_links, component)}`` by comparing all pairs."""
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = {i: set() for i in range(len(rows))}
    unit = {i: np.asarray(rows[i][1], np.float64) / np.linalg.norm(np.asarray(rows[i][1], np.float64)) for i in ok}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93:
                linked[a].add(b)
    out = {}
    for i in linked:
        reach, todo = {i}, [i]
        while todo:
            for b in linked[todo.pop()] - reach:
                reach.add(b)
                todo.append(b)
        out[i] = len(linked[i]), min(rows[j][0] for j in reach)
    return out


def clustered(rng, n, dim=16):
    base = rng.normal(size=(n, dim))
    out = [base]
    for k in range(n // 3):  # pairs, and groups of many
        out.append(base[k] + 0.15 * rng.normal(size=(1 if k else n // 2, dim)))
    return np.concatenate(out).astype(np.float32)


@pytest.mark.parametrize("shard_rows", [8192, 64])
def test_equals_all_pairs(spark, shard_rows):
    rng = np.random.default_rng(4)
    rows = [(1000 - i, v.tolist(), int(i % 2)) for i, v in enumerate(clustered(rng, 150))]
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(30)]  # copies
    rows += [(3000, [2 * x for x in rows[3][1]], rows[3][2]), (3001, rows[3][1], 9), (3002, rows[3][1], None), (3003, None, 1)]
    rows += [(3004, [0.0] * 16, 1), (3005, [1.0, None] + [0.0] * 14, 1), (3006, [float("nan")] * 16, 1), (3007, [float("inf")] + [1.0] * 15, 1)]
    rows += [(3008, [], 1), (3009, [1.0, 2.0], 1), (3010, [1.0, 2.0], 1), (3011, [1e30] * 16, 1), (3012, [1e-30] * 16, 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    got = {r["id"]: r for r in hnsw.near_duplicates(frame, shard_rows=shard_rows).collect()}
    wanted = slow(rows)
    assert len(got) == len(rows)
    for i, (vec, *_) in enumerate(rows):
        assert (got[vec]["n_links"], got[vec]["component_id"]) == wanted[i], vec
        assert got[vec]["kept"] == (vec == wanted[i][1])


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 1, "", 0), (1, [1.0, 0.0], 1, "", 0), (None, [1.0, 0.0], 1, "", 0), (None, [0.0, 1.0], 1, "", 0)]
    frame = spark.createDataFrame(rows, VECTORS)
    out = hnsw.near_duplicates(frame).collect()
    assert sorted((r["id"] or -1, r["n_links"], r["component_id"] or -1) for r in out) == [(-1, 0, -1), (-1, 2, 1), (1, 2, 1), (1, 2, 1)]
    assert hnsw.near_duplicates(frame.limit(0)).count() == 0


def test_recall_of_a_graph_on_vectors_of_other_shards():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(3000, 64))
    near = base + 0.2 * rng.normal(size=base.shape)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    base, near = unit(base), unit(near)
    truth = {(a, b) for a, b in np.argwhere(near @ base.T >= 0.93).tolist()}
    found = {(a, b) for a, b in np.argwhere(hnsw.audited(hnsw.build(base), near, 0.93)).tolist()}
    assert found <= truth and len(found) >= 0.97 * len(truth)


def test_beams_wider_than_a_group_find_all_of_it():
    rng = np.random.default_rng(1)
    group = rng.normal(size=16) + 0.05 * rng.normal(size=(700, 16))
    unit = (group / np.linalg.norm(group, axis=1, keepdims=True)).astype(np.float32)
    assert (hnsw.audited(hnsw.build(unit), unit, 0.93, own=True) == (unit @ unit.T >= 0.93)).all()


def test_a_large_group_does_not_hide_missed_pairs(monkeypatch):
    """A search that finds the large group only, unless its beam is wider, fails the audit."""
    rng = np.random.default_rng(8)
    unit = rng.normal(size=(800, 64))
    unit[:600] = unit[0] + 0.01 * rng.normal(size=(600, 64))
    unit[601::2] = unit[600::2] + 0.01 * rng.normal(size=(100, 64))
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    near = unit @ unit.T >= 0.93

    def search(graph, asks, least, width, own=False):
        row, node = np.nonzero(near)
        some = (row < 600) | (width > hnsw.BEAM)
        yield row[some], node[some]

    monkeypatch.setattr(hnsw, "search", search)
    for own in (True, False):
        assert (hnsw.audited(hnsw.Graph(unit, []), unit, 0.93, own=own) == near).all()


def test_only_audited_rows_are_searched_until_a_beam_passes(monkeypatch):
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(4000, 32))
    unit[1::2] = unit[::2] + 0.02 * rng.normal(size=(2000, 32))
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    near = unit @ unit.T >= 0.93
    asked = []

    def search(graph, asks, least, width, own=False):
        asked.append((len(asks), width))
        rows = np.arange(len(asks)) if own is True else own
        row, node = np.nonzero(near[rows])
        keep = (rows[row] == node) | (width > 2 * hnsw.BEAM - 1)
        yield row[keep], node[keep]

    monkeypatch.setattr(hnsw, "search", search)
    assert (hnsw.audited(hnsw.Graph(unit, []), unit, 0.93, own=True) == near).all()
    assert asked == [(hnsw.AUDIT_ROWS, hnsw.BEAM), (hnsw.AUDIT_ROWS, 2 * hnsw.BEAM), (4000, 2 * hnsw.BEAM)]
    # a search that never finds anything ends in comparing all, after few rows
    asked.clear()
    monkeypatch.setattr(hnsw, "search", lambda g, asks, least, width, own=False: asked.append(len(asks)) or iter(()))
    assert (hnsw.audited(hnsw.Graph(unit, []), unit, 0.93, own=True) == near).all()
    assert set(asked) == {hnsw.AUDIT_ROWS}


def test_graphs_end_to_end(spark, monkeypatch):
    """Thousands of vectors per label in several shards, pairs and small groups beside a
    large one, through beams: recall of vectors and of groups against brute force."""
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1):
        base = rng.normal(size=(3200, 64))
        big = rng.normal(size=64) + 0.12 * rng.normal(size=(900, 64))
        few = [base[k] + 0.18 * rng.normal(size=(int(rng.integers(1, 6)), 64)) for k in range(500)]
        vectors = np.concatenate([base, big, *few]).astype(np.float32)
        rows += [(100_000 * label + i, v.tolist(), label) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(frame, shard_rows=2400).collect()}
    linked = right = groups = whole = 0
    for label in (0, 1):
        own = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.93
        np.fill_diagonal(near, False)
        assert not hnsw.dear(hnsw.BEAM, len(own) // -(-len(own) // 2400) - 200)  # the beams are used
        component = np.arange(len(own))
        while True:
            least = np.where(near, component[None, :], len(own)).min(axis=1)
            new = np.minimum(component, least)
            if (new == component).all():
                break
            component = new
        n = near.sum(axis=1)
        for i in np.flatnonzero(n):
            linked += 1
            right += got[own[i][0]] == (n[i], own[component[i]][0])
        for c in set(component[n > 0].tolist()):
            groups += 1
            whole += all(got[own[i][0]] == (n[i], own[c][0]) for i in np.flatnonzero(component == c))
        assert all(got[own[i][0]] == (0, own[i][0]) for i in np.flatnonzero(n == 0))
    print(f"vectors {right}/{linked}, groups {whole}/{groups}")
    assert right >= 0.99 * linked and whole >= 0.98 * groups
