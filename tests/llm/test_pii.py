"""Personal data: base spans against plain regular expressions, labelers and classifier on planted cases."""

import hashlib
import re
import time

import numpy as np
import pytest

from harborlight.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if fits(kind, m[0])]


def carded(prefix, n=16):
    return next(prefix + str(i).zfill(n - len(prefix)) for i in range(37, 10**6) if fits("card", (prefix + str(i).zfill(n - len(prefix))).zfill(16)))


def test_base_equals_regular_expressions():
    rng = np.random.default_rng(3)
    alphabets = ["ab1.@-_%+ ", "0123456789. -", "+12 ()-.x", "12.34.5255 ", "a@b.c+1 2-(é漢"]
    pieces = ["12.34.56.78", "a.b@c.de", "@x.y", "+1 (487) 555-7209", carded("4111"), carded("5500") + " " + carded("4"), "999.1.1.1", "00255.01.1.1.9", "+1234567"]
    for i in range(6_000):
        text = "".join(rng.choice(list(alphabets[i % len(alphabets)]), size=rng.integers(0, 60)))
        if i % 3 == 0:
            text = text[:20] + str(rng.choice(pieces)) + text[20:40] + str(rng.choice(pieces)) + text[40:]
        assert pii.base(text) == plain(text), text


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000, "+1" * 150_000, "+1" + " " * 300_000, "@a." * 100_000, "1." * 150_000, "a@" * 150_000, "1 " * 150_000, "(at)a" * 60_000, "1:" * 150_000, "9-9" * 100_000])
def test_linear(text):
    began = time.perf_counter()
    pii.candidates(text)
    assert time.perf_counter() - began < 20


def rows_of(spark, docs, **more):
    found = pii.found(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"], **more)
    return {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in found.collect()}


def corpus():
    """Plain cases that labelers agree on, and the hidden ones whose spans the base misses."""
    rng = np.random.default_rng(5)
    docs = []
    for i in range(120):
        a, b = rng.integers(1, 250, 2)
        docs.append((i, f"Please write to user{i}@mail{a}.com or call +1 ({200 + a}) 555-{1000 + b}, host {a}.{b}.7.{i}, card {carded(f'4{i:03}{a:03}')} today"))
        docs.append((1_000 + i, f"order {a}{b}-{i}-12, version {i}.{a}, serial {rng.integers(10**13, 10**14)} 7 {i} 3 and page {b}-{a}-{i}00"))
    hidden = {
        5_000: (f"card {carded('4111')} {carded('5500')} end", {("card", 5, 21, False), ("card", 22, 38, False)}),
        5_001: ("call +1 (487) 555-7209 2024001 now", {("phone", 5, 22, False)}),
        5_002: ("email: jane.doe (at) example.com please", {("email", 7, 32, False)}),
        5_003: (f"credit card: {carded('4', 16)[:4]} {carded('4', 16)[4:8]} {carded('4', 16)[8:12]} {carded('4', 16)[12:]} 12 27", set()),
        5_004: ("nothing at all. here 1234 of them", set()),
    }
    return docs + [(k, v[0]) for k, v in hidden.items()], hidden


def test_hidden_spans_are_added_and_clean_texts_left(spark):
    docs, hidden = corpus()
    found = rows_of(spark, docs)
    for doc_id in (5_000, 5_001, 5_002):
        assert hidden[doc_id][1] <= set(found[doc_id]), (doc_id, found[doc_id])
    assert found[5_004] == []
    for doc_id, text in docs:
        fixed = [(pii.KINDS[k], a, b) for k, a, b in plain(text)]
        assert sorted(x[:3] for x in found[doc_id] if x[3]) == sorted(fixed)
    wrong = [x for doc_id, spans in found.items() if 1_000 <= doc_id < 5_000 for x in spans if not x[3]]
    assert len(wrong) <= 2, wrong


def test_em_ranks_a_bad_labeler_below_a_good_one():
    rng = np.random.default_rng(1)
    true = rng.random(4_000) < 0.5
    right = np.array([0.95, 0.9, 0.85, 0.55, 0.8, 0.5])
    said = rng.random((4_000, 6)) < right
    given = np.where(said == true[:, None], pii.YES, pii.NO)
    p, theta, share = pii.reliabilities(given, np.ones(4_000))
    assert ((p > 0.5) == true).mean() > 0.96 and abs(share[1] - 0.5) < 0.05
    assert np.allclose(theta[1, :, pii.YES], right, atol=0.04)
    w = pii.classifier(pii.features(given, np.zeros((4_000, 4))), p, np.ones(4_000))
    assert w[1] > w[4] and abs(w[6]) < 0.6 < w[1]


def test_patterns_decode():
    code = pii.votes("card 4111", pii.CARD, 5, 9, False)
    kind, given, shape = pii.decoded(code)
    assert kind == pii.CARD and given[3] == pii.YES and len(given) == len(pii.LABELERS) and len(shape) == pii.SHAPES


def test_query_columns_and_defined_cases(spark, tmp_path):
    docs = [(1, None, "a"), (2, "", "b"), (None, "a@b.cd", "c"), (3, "a@b.cd 1.2.3.4", "d"), (3, "a@b.cd 1.2.3.4", "d")]
    spark.createDataFrame(docs, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    from harborlight.llm.queries import op13_personal_data

    rows = op13_personal_data(spark, str(tmp_path)).collect()
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert sorted((r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in rows) == [
        (0, 1, 0, 0, 0, "email:0:6"), (1, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, ""), *[(3, 1, 1, 0, 0, "email:0:6,ip:7:14")] * 2
    ]
    assert {r.base_sha256 for r in rows} == {digest(""), digest("email:0:6"), digest("email:0:6,ip:7:14")}


def test_redacted_and_empty(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd, 1.2.3.4!", 5), (2, None, 6)], "doc_id long, text string, _row int")
    assert [tuple(r) for r in pii.redacted(docs).orderBy("doc_id").collect()] == [(1, "mail [EMAIL], [IP]!", 5), (2, None, 6)]
    assert pii.found(docs.limit(0)).count() == 0
