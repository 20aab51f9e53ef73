"""Near-duplicates of the pipeline against all pairs' exact Jaccard similarities."""

import numpy as np
import pytest

from harborlight.llm import near
from tests.llm.test_near import union_find
from tests.llm.test_texts import prose

SCHEMA = "doc_id long, text string"


def shingles(text, size=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ")
    words = [w for part in words for w in part.replace("\t", "\n").split("\n") if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def alike(a, b):
    return (not a and not b) or len(a & b) >= 0.8 * len(a | b)


def families(seed=4):
    """Originals, copies with some words changed, long chains of small changes, and texts that are alone."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(25):
        words = prose(rng, rng.integers(3, 300)).split()
        for _ in range(int(rng.integers(1, 7))):
            copy = list(words)
            for i in rng.choice(len(copy), int(len(copy) * rng.uniform(0, 0.05)), replace=False):
                copy[i] = f"x{rng.integers(1000)}"
            rows.append((len(rows), " ".join(copy)))
    chain = prose(rng, 200).split()
    for step in range(12):
        chain[step * 15] = f"y{step}"
        rows.append((len(rows), "\n".join(chain).title()))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "Four words are here"), (904, "four WORDS are  here"), (None, rows[0][1]), (None, prose(rng, 40)), (905, rows[0][1]), (905, rows[0][1])]
    return rows


def test_groups_equal_brute_force(spark):
    rows = families()
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    found = near.grouped(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    group = {}
    for r in found:
        group.setdefault((r.doc_id, r.digest), r.group)
    digests = {r.asDict()["doc_id"]: r.digest for r in found if r.doc_id is not None}
    of = [group[d, digests[d]] for d, _ in rows if d is not None]
    kept = [i for i, (d, _) in enumerate(rows) if d is not None]
    roots = union_find(range(len(rows)), links)
    linked = [(i, j) for i, j in links if i in kept and j in kept]
    assert sum(of[kept.index(i)] == of[kept.index(j)] for i, j in linked) >= 0.97 * len(linked)
    for x, i in enumerate(kept):
        for y, j in enumerate(kept):
            assert of[x] != of[y] or roots[i] == roots[j]  # no group holds what isn't linked
    left = near.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(left) == len({r.group for r in found})


@pytest.mark.parametrize("few, piece", [(24, 512), (100, 512), (2, 7)])
def test_dissimilar_texts_of_one_bucket_stay(spark, monkeypatch, few, piece):
    """With keys that all share, only the verification decides, in all ways of the second round."""
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "PIECE", piece)
    real = near.sketch
    monkeypatch.setattr(near, "sketch", lambda h, bands, rows: (real(h, bands, rows)[0], 0, [1] if len(h) else []))
    rng = np.random.default_rng(9)
    texts = [prose(rng, 60) for _ in range(6)]
    rows = [(k, texts[k % 6] + (f" end {k}" if k > 11 else "")) for k in range(30)]
    sets = [shingles(t) for _, t in rows]
    roots = union_find(range(30), [(i, j) for i in range(30) for j in range(i) if alike(sets[i], sets[j])])
    found = {r.doc_id: r.group for r in near.grouped(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(set(found.values())) == 6
    assert all((found[i] == found[j]) == (roots[i] == roots[j]) for i in range(30) for j in range(30))


def test_empty_and_repeated(spark):
    assert near.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None), (None, ""), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (4, "a " * 50_000)]
    assert sorted(r.doc_id or 0 for r in near.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()) == [0, 2, 4]


@pytest.mark.parametrize("words, size", [("a b c d e", 1), ("a b c d e f", 2), ("a b", 1), ("", 0)])
def test_shingles(words, size):
    assert len(near.shingles(words)) == size
