"""Importance resampling against a plain version, and its byte automaton against regular expressions and zlib."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from harborlight.llm import resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORDS.findall(low)
    return words, [zlib.crc32(x.encode()) % 10_000 for x in words + [" ".join(p) for p in zip(words, words[1:])]]


def plain(docs, target, percent=25, least=20):
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            np.add.at(counts, runs(text)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s.tolist(), t.tolist())]
    rows = []
    for doc_id, text in docs:
        words, buckets = runs(text)
        weight = sum(gain[b] for b in buckets) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(buckets), weight, score, len(words) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted((r[:4] + [rank.get(id(r))] for r in rows), key=str)


def made(seed, n):
    rng = np.random.default_rng(seed)
    words = ["alpha", "Beta", "gamma9", "été", "漢字", "x", "DELTA-e", "o'n", "y_z", "\x00", "\x7f", "ÀB"]
    return [" ".join(rng.choice(words, size=rng.integers(0, 60))) for _ in range(n)]


def got(spark, docs, target, **more):
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    found = resampling.numbered(rows, spark.createDataFrame([(t,) for t in target], "text string"), ["doc_id"], **more)
    return sorted((list(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_equals_plain(spark):
    docs = [*enumerate(made(1, 200)), (7, made(2, 1)[0]), (None, made(3, 1)[0]), (None, None), (900, ""), (901, "the " * 30_000), (902, "q" * 5_000 + " r" * 25)]
    docs += [(500 + i, docs[3][1]) for i in range(40)] + [docs[5]] * 3
    target = made(4, 30) + [None, ""]
    assert got(spark, docs, target) == plain(docs, target)


@pytest.mark.parametrize("docs, target", [([], ["a b"]), ([(1, "a " * 25)], []), ([(1, "few words")] * 3, ["a"]), ([(None, None)], [])])
def test_small(spark, docs, target):
    assert got(spark, docs, target) == plain(docs, target)


def test_all_ids_null_and_all_equal(spark):
    docs = [(None, "a b c d " * 6)] * 41
    found = got(spark, docs, ["a b"])
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 11)) and len(found) == 41


def test_clashing_names_and_other_columns(spark):
    rows = spark.createDataFrame([(i, "w " * (20 + i), "k", i, {"m": i}) for i in range(8)], "doc_id long, text string, _score string, RANK int, bag map<string, int>")
    found = resampling.resampled(rows, spark.createDataFrame([("w v",)], "text string"))
    assert found.count() == 2 and {"doc_id", "text", "_score", "bag", "rank", "score"} <= set(found.columns) and "RANK" not in found.columns
    assert all(r.bag == {"m": r.doc_id} and r._score == "k" for r in found.collect())


@pytest.mark.parametrize("block, size", [(1 << 18, 1 << 22), (7, 40)])
def test_byte_automaton(monkeypatch, block, size):
    monkeypatch.setattr(resampling, "BLOCK", block)
    monkeypatch.setattr(resampling, "BYTES", size)
    texts = [*made(5, 60), None, "", "z" * 200 + " y", "é" * 90]
    for column in (pa.array(texts), pa.array(texts).slice(3, 50), pa.array(texts, pa.large_string())):
        found = {i: [] for i in range(len(column))}
        for text, bucket, _ in resampling.runs_of(column):
            for i, b in zip(text.tolist(), bucket.tolist()):
                found[i].append(b)
        assert [sorted(found[i]) for i in range(len(column))] == [sorted(runs(t)[1]) for t in column.to_pylist()]
