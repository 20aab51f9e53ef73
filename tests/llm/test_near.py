from __future__ import annotations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from harborlight.llm import simhash, vectors
from harborlight.llm.components import components


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B", "A b c d É\x1ff g", "x " * 40_000, "the cat sat on the mat " * 3])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_fingerprints_within_three_bits_share_an_own_key(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    key, at, own = simhash.keys_of(np.array([fp, other], dtype=np.uint64).view(np.int64))
    mine = set(key[(at == 0) & own])
    assert len(mine) == 8 and mine & set(key[at == 1])


def test_golay_balls_part_the_space():
    _, _, errors = simhash.golay()
    assert (errors[:, 0] >= 0).all()
    weights = np.array([[bin(e).count("1") if e >= 0 else -1 for e in row] for row in errors])
    assert set(map(tuple, weights)) == {(0, -1, -1, -1, -1, -1), (1, -1, -1, -1, -1, -1), (2, -1, -1, -1, -1, -1), (3, 4, 4, 4, 4, 4)}


def test_components_equal_union_find(spark):
    random = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == union_find({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies():
    random = np.random.default_rng(2)
    words = [f"w{i}" for i in range(500)]
    rows, i = [], 0
    for _ in range(25):
        base = list(random.choice(words, 260))
        for k in range(5):
            copy = base.copy()
            for _ in range(k):
                copy[random.integers(0, 260)] = "changed"
            rows.append((i := i + 1, " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, "  "), (903, rows[0][1]), (903, rows[0][1]), (904, "A b"), (None, "lone text here"), (None, rows[0][1])]


def test_simhash_components_equal_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fp", "'y' AS component_id")
    fps = [slow_fingerprint(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    roots = union_find(range(len(rows)), edges)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[roots[k]] = min((x for x in (least.get(roots[k]), i) if x is not None), default=None)
    expected = sorted((str(i), fps[k], str(least[roots[k]])) for k, (i, _) in enumerate(rows))
    got = sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in simhash.labelled(docs).collect())
    assert got == expected
    assert any(len({fps[k] for k in roots if roots[k] == r}) > 1 for r in roots.values())
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(roots.values()))


def test_simhash_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.labelled(docs).count() == 0 and simhash.deduplicated(docs).count() == 0


def vector_rows():
    """Groups of near vectors of length 16, others of length 5 and 1, and vectors that can't link."""
    random = np.random.default_rng(3)
    base = random.normal(size=(40, 16))
    x = np.vstack([base, base[:20] + random.normal(0, 0.07, (20, 16)), base[:5], base[:10] * 3 + random.normal(0, 0.2, (10, 16)), base[:3] * 2, np.tile(base[0], (30, 1)) + random.normal(0, 0.04, (30, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    short = random.normal(size=(30, 5))
    rows += [(2000 + i, v, 0) for i, v in enumerate(np.vstack([short, short[:9] + random.normal(0, 0.05, (9, 5))]).astype(np.float32).tolist())]
    rows += [(3000, [1.0], 0), (3001, [2.0], 0), (3002, [-2.0], 0), (3003, [1.0] * 3, 0), (3004, [1.0] * 3, 0)]
    one = rows[0][1]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [], [float("inf")] + [1.0] * 15, [*one, None], [None, *one], [None] + one[1:], [*one[:15], float("nan")]]
    return rows, [(1000 + i, v, 0) for i, v in enumerate(odd)]


@pytest.mark.parametrize(("cell", "chunk"), [(16_384, 16_384), (16, 16_384), (8, 5)])
def test_vectors_equal_brute_force(spark, monkeypatch, cell, chunk):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    monkeypatch.setattr(vectors, "PAIRS", chunk)
    rows, odd = vector_rows()

    def cosine(a, b):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if len(a) == len(b) else -1

    near = {(i, j) for i, a, _ in rows for j, b, _ in rows if i != j and cosine(a, b) >= 0.95}
    roots = union_find([i for i, _, _ in rows], near)
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumnRenamed("label", "n")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.labelled(frame).collect()}
    assert got == {i: (sum(a == i for a, _ in near), roots[i], roots[i] == i) for i in roots} | {i: (0, i, True) for i, _, _ in odd}
    assert len(near) > 900 and any(i > 2000 for i, _ in near)


def test_vectors_without_ids_and_of_doubles(spark):
    rows = [(None, [1.0, 0.0]), (7, [1.0, 0.01]), (7, [1.0, 0.01]), (None, [0.0, 1.0]), (None, None)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in vectors.labelled(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [("7", 2, 7, True), ("7", 2, 7, True), ("None", 0, None, True), ("None", 0, None, True), ("None", 2, 7, False)]


def test_vectors_of_extreme_components(spark):
    rows = [(1, [1e-200, 0.0, 0.0]), (2, [2e-200, 0.0, 0.0]), (3, [1e200, 1.0]), (4, [2e200, 1.0]), (5, [1e-320, 1e-320]), (6, [3.0, 3.0]), (7, [1e308, 1e308]), (8, [-1e308, 1e308])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.labelled(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (2, 5), 6: (2, 5), 7: (2, 5), 8: (0, 8)}


def test_vectors_of_nothing(spark):
    assert vectors.labelled(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
