"""SimHash groups against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from codeloom.llm import simhash
from codeloom.llm.components import components

DOCS = "doc_id long, text string, fp string, id int, component_id string"


def slow_fingerprint(text, words=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps, radius):
    """``{id: smallest id in reach}`` by comparing all pairs."""
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= radius and label[a] < label[b]:
                    label[b], changed = label[a], True
    return label


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    texts = {}
    for i in range(60):
        base = [word() for _ in range(rng.choice([1, 3, 5, 40, 300]))]
        texts[3 * i] = " ".join(base)
        near = list(base)
        near[rng.randrange(len(near))] = word()
        texts[3 * i + 1] = "\t".join(near)
        texts[3 * i + 2] = "\n ".join(base).upper() if i % 2 else "  ".join(base)
    texts[500], texts[501], texts[502] = None, "", " \n\t "
    texts[503] = "same " * 20_000  # very long, one shingle over and over
    texts[504] = " ".join(word() for _ in range(40_000))
    texts[505] = "nbsp is no break;   neither"
    return texts


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "x", 1, "y") for i, t in corpus().items()]
    out = simhash.near_duplicates(spark.createDataFrame(rows, DOCS))
    return {r["id"]: r for r in out.collect()}


def test_fingerprints_and_groups_equal_brute_force(found):
    fps = {i: slow_fingerprint(t) for i, t in corpus().items()}
    assert {i: int(r["fp"].hex(), 16) for i, r in found.items()} == fps
    assert {i: r["component_id"] for i, r in found.items()} == slow_groups(fps, 4)


def test_texts_without_words_have_fingerprint_zero(found):
    assert {found[i]["fp"].hex() for i in (500, 501, 502)} == {"0" * 16}
    assert found[502]["component_id"] <= 500


def test_links_at_each_distance_and_chunked_shards(spark, monkeypatch):
    """Chains of fingerprints at known distances; chunks far smaller than the shards."""
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 40)
    monkeypatch.setattr(simhash, "PROBE_EVERY", 2)
    rng = random.Random(9)
    base, fps = rng.getrandbits(64), {}
    for i in range(300):  # one large shard in four of five tables, whose others differ
        fps[i] = base ^ (rng.getrandbits(13) if i % 2 else rng.getrandbits(13) << 13)
    for i in range(300, 400):
        fps[i] = rng.getrandbits(64)
        for k in range(rng.choice([1, 4, 5])):
            fps[i] ^= 1 << rng.randrange(64)
    unique = {}
    for i, f in fps.items():
        unique.setdefault(f, i)
    rows = [(i, f.to_bytes(8, "big")) for f, i in unique.items()]
    groups = spark.createDataFrame(rows, "rep long, fp binary")
    links = simhash.links(groups, simhash.SimHash())
    assert links.count() < 20 * len(rows)
    label = {r["node"]: r["label"] for r in components(links).collect()}
    wanted = slow_groups({i: f for f, i in unique.items()}, 4)
    assert {i: label.get(i, i) for i in wanted} == wanted


def test_tree_search_equals_scan():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << 20, (400, 1)).astype(np.uint64)
    cells = rng.integers(0, 3, 400)
    forest = simhash.Forest(points, np.arange(400), cells, 64)
    asks = np.arange(400)
    roots = np.array([forest.roots[c] for c in cells.tolist()])
    got = {(int(a), int(b)) for part in forest.search(asks, roots, 5) for a, b in zip(*part)}
    near = np.bitwise_count(points ^ points.T) <= 5
    assert got == {(a, b) for a, b in np.argwhere(near).tolist() if cells[a] == cells[b]}


def test_repeated_and_null_ids(spark):
    text = "one two three four five six"
    rows = [(7, text, "", 0, ""), (7, text, "", 0, ""), (9, text, "", 0, ""), (None, text, "", 0, ""),
            (9, "something else entirely, that is far away", "", 0, ""), (None, "alone in the world", "", 0, "")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["id"] or -1, r["component_id"] or -1) for r in out) == [
        (-1, -1), (-1, 7), (7, 7), (7, 7), (9, 7), (9, 7)
    ]


def test_keep_one_each(spark):
    rng = random.Random(5)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randint(0, 400)) for _ in range(400)]
    near = list(words)
    near[100], near[300] = "changed", "twice"
    other = [w[::-1] + "x" for w in words]
    rows = [(5, " ".join(words), "a", 1, None), (2, " ".join(near), "b", 2, None), (3, " ".join(other), "c", 3, None),
            (3, " ".join(other), "d", 4, None), (None, " ".join(words), "e", 5, None), (8, " ".join(words), "f", 6, None)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash.keep_one_each(docs, simhash.NEAR_COPIES)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2, 3]


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one_each(docs, simhash.NEAR_COPIES).count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)]
    pairs += [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)] + [(3000, 3000), (None, 4)]
    rng.shuffle(pairs)
    links = spark.createDataFrame(pairs, "a long, b long")
    label = {r["node"]: r["label"] for r in components(links).collect()}
    assert {label[i] for i in range(201)} == {0}
    assert {label[i] for i in range(1000, 1100)} == {1000}
    assert {label[i] for i in range(2000, 2007)} == {2000}
    assert 3000 not in label


def shingles_of(text, words=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def jaccard(a, b):
    x, y = shingles_of(a), shingles_of(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def slow_similar(texts, least=0.8):
    label = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if label[a] < label[b] and jaccard(texts[a], texts[b]) >= least:
                    label[b] = label[a]
    return label


def test_a_repeated_line_makes_no_copies(spark):
    """Distinct texts below one repeated menu stay; the fingerprints alone link them."""
    rng = random.Random(11)
    menu = "home news shop about us contact terms and privacy here\n" * 20
    rows = [(i, menu + " ".join(f"w{rng.randrange(10**6)}" for _ in range(200)), "", 0, "") for i in range(12)]
    docs = spark.createDataFrame(rows, DOCS)
    fps = [int.from_bytes(simhash.fingerprint(r[1].encode(), 5, 256), "big") for r in rows]
    assert sum((a ^ b).bit_count() <= 48 for a in fps for b in fps) > len(fps)
    kept = simhash.keep_one_each(docs, simhash.NEAR_COPIES).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(12))


def test_a_failing_link_hides_no_passing_one(spark):
    """Chains of edits: neighbours are similar, the ends are not, and the first of a group
    is similar to few; also texts that are near but not similar enough."""
    rng = random.Random(4)
    texts, i = {}, 0
    for _ in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(240)]
        steps = []
        for _ in range(7):
            steps.append(" ".join(words))
            for k in rng.sample(range(240), rng.choice([2, 3, 9])):
                words[k] = f"x{rng.randrange(10**6)}"
        rng.shuffle(steps)
        for text in steps:
            texts[i], i = text, i + 1
    texts |= {90: None, 91: "", 92: "too short", 93: "Too  short"}
    docs = spark.createDataFrame([(k, t, "", 0, "") for k, t in texts.items()], DOCS)
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs, simhash.NEAR_COPIES).collect()}
    wanted = slow_similar(texts)
    assert 8 < len(set(wanted.values())) < len(texts) - 8
    assert got == wanted


def recall(how, pairs, n, jaccard_, seed):
    """The share of isolated pairs of random sets that become candidates."""
    rng = np.random.default_rng(seed)
    common = round(2 * n * jaccard_ / (1 + jaccard_))
    sides = [[], []]
    for _ in range(pairs):
        hashes = rng.integers(0, 1 << 64, 2 * n - common, np.uint64)
        for side, own in zip(sides, (hashes[:n], hashes[n - common :])):
            side.append(simhash.majority([own], how.bits))
    a, b = (np.unpackbits(np.frombuffer(b"".join(s), np.uint8).reshape(pairs, -1), axis=1) for s in sides)
    differ = a != b
    meets = np.any([~differ[:, key].any(axis=1) for key in how.keys()], axis=0)
    return (meets & (differ.sum(axis=1) <= how.radius)).mean()


def test_isolated_pairs_at_the_similarity_are_candidates():
    for n in (45, 180, 900):
        assert recall(simhash.NEAR_COPIES, 1500, n, 0.8, n) >= 0.995


def test_how_often_a_shingle_occurs_does_not_count(spark):
    line, words = "one menu line that is repeated in both of these texts", " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"{line} " * n + words, "", 0, "") for i, n in enumerate((2, 40))]
    out = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), simhash.NEAR_COPIES).collect()
    assert {r["component_id"] for r in out} == {0} and len({r["fp"] for r in out}) == 1


def test_a_large_group_of_near_but_dissimilar_texts(spark):
    """5,000 texts of one fingerprint neighbourhood, few of which are similar: what passes is
    found among what does not, and the links are at most as many as the texts."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(60)]
    members, texts = [], []
    for i in range(5000):
        own = list(words)
        for k in rng.sample(range(60), 14):
            own[k] = f"x{rng.randrange(10**9)}"
        if i % 10 == 9:  # one word away from an earlier text
            own = list(rng.choice(texts[:i]))
            own[rng.choice([0, 59])] = f"y{rng.randrange(10**9)}"
        texts.append(own)
    from codeloom.llm.setlinks import links_between

    sets = [simhash.shingle_set(" ".join(t).encode(), 5) for t in texts]
    for i, own in enumerate(sets):
        members.append((0, i, i, simhash._set_name(own), own.view(np.int64).tolist()))
    frame = spark.createDataFrame(members, "label long, comp long, rep long, same binary, shingles array<long>")
    found = [(r["a"], r["b"]) for r in links_between(frame.repartition(8), 0.8).collect()]
    index = {}
    for i, own in enumerate(sets):
        for token in own.tolist():
            index.setdefault(token, []).append(i)
    similar = {}
    for i, own in enumerate(sets):
        counts = {}
        for token in own.tolist():
            for j in index[token]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        similar[i] = [j for j, n in counts.items() if n >= 0.8 * (len(own) + len(sets[j]) - n)]

    def united(pairs):
        label = list(range(len(sets)))

        def find(i):
            while label[i] != i:
                label[i] = label[label[i]]
                i = label[i]
            return i

        for a, b in pairs:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
        return [find(i) for i in range(len(sets))]

    assert united(found) == united((i, j) for i in similar for j in similar[i])
    assert all(jaccard(" ".join(texts[a]), " ".join(texts[b])) >= 0.8 for a, b in found)
    assert 400 < len(found) < 5 * len(sets)


def test_links_between_cells_cut_into_chunks_and_tasks(spark, monkeypatch):
    from codeloom.llm import setlinks

    monkeypatch.setattr(setlinks, "TASK_BYTES", 4000)
    monkeypatch.setattr(setlinks, "CELL_BYTES", 1000)
    monkeypatch.setattr(setlinks, "BLOCK_TOKENS", 10)
    rng = random.Random(2)
    rows = []
    for label in range(4):
        base = rng.sample(range(10**6), 40)
        for i in range(60):
            own = sorted({t if rng.random() > 0.09 else rng.randrange(10**6) for t in base} | {label})
            rep = 100 * label + i
            rows.append((label, rep - rep % 2 if i < 20 else rep, rep, str(rep).encode(), own))
    rows.append((0, 5000, 5000, b"none", []))
    frame = spark.createDataFrame(rows, "label long, comp long, rep long, same binary, shingles array<long>")
    found = {(r["a"], r["b"]) for r in setlinks.links_between(frame, 0.8).collect()}
    sets = {rep: set(own) for _, _, rep, _, own in rows}
    links = {(a, b) for a in sets for b in sets if b < a and a // 100 == b // 100 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(max(p), min(p)) for p in found} <= links
    label = {r: c for _, c, r, *_ in rows}

    def united(pairs):
        own = dict(label)
        while True:
            before = dict(own)
            for a, b in pairs:
                x, y = own[a], own[b]
                own = {r: min(x, y) if c in (x, y) else c for r, c in own.items()}
            if own == before:
                return own

    assert united(found) == united(links) and len(set(united(links).values())) > 4
