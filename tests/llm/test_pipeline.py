from __future__ import annotations

import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harborlight.llm import decontam, near
from harborlight.llm.common import shared_folder, table
from harborlight.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_jaccard import alike, shingles
from tests.llm.test_near import union_find
from tests.llm.test_texts import overlap


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name == "near_duplicates":
            groups = near.grouped(docs).collect()
            assert len({r.group for r in groups}) == len(groups)
        if name == "decontamination":
            assert decontam.contaminated(docs, table(spark, sf_dir, "benchmark")).count() == 0
        assert docs.columns[: len(columns)] == columns
    assert counts[0] >= counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    size = defaultdict(int)
    for r in docs.collect():
        size[r.shard] += r.size
    assert len(size) > 30


def test_run_gives_shards(spark, sf_dir):
    assert {"shard", "slot", "doc_id"} <= set(corpus_pipeline.run(spark, sf_dir).columns)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.fixture
def odd_docs(spark, sf_dir):
    """Some documents with nulls, repeated rows, a long text and columns that clash."""
    docs = table(spark, sf_dir, "documents").where("doc_id < 60")
    text = docs.where("lang = 'en'").orderBy("doc_id").first().text
    odd = [(None, text, "en", "web", 1), (None, text + " More.", "en", None, 1), (7001, None, None, None, None), (7002, "", "en", "web", 0), (7003, " ?!", "de", "web", 1),
           (7004, (text + " ") * 300, "en", "books", 2), (7004, (text + " ") * 300, "en", "books", 2), (7005, text, None, "web", 3)]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "'x' AS shard", "1.5 AS score", "'fp' AS fp", "2 AS _row", "map(1, 2) AS more")


def test_stages_on_odd_input(spark, sf_dir, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == odd_docs.columns, name
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert not {7001, 7002, 7003} & set(ids)
        if name == "language":
            assert ids.count(None) == 2 and ids.count(7004) == 2 and 7005 in ids
        if name == "near_duplicates":
            assert not {7004, 7005} & set(ids) and len(ids) == len(set(ids))  # copies of a text with a smaller id
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert set(odd_docs.columns) | {"size", "text_crc32", "law", "slot"} == set(out.columns) and out.count() == docs.count()
    assert {r.shard for r in out.select("shard").collect()} <= set(range(40))


def test_no_documents_and_no_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert corpus_pipeline.staged(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), sf_dir).count() == 0


def test_scratch_is_removed(spark, sf_dir):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    corpus_pipeline.run(spark, sf_dir).count()
    (left,) = [p for p in set(folder.iterdir()) - before if p.name.startswith("pipeline")]
    assert [p.name for p in left.iterdir() if not p.name.startswith(".")] == ["mixing"]
    assert not [p for p in set(folder.iterdir()) - before if p.name.startswith("scratch")]


def test_mixing_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    got = QUERIES["op1_mixing"](spark, sf_dir).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op1_mixing']})").fetchall())


def test_registered_queries(spark, sf_dir):
    """Columns, rows and what is held out, of the queries that SQL can't express."""
    docs = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    for name, rest in (("op4_quality", (5, 0)), ("op8_language_id", (4, 2))):
        got = QUERIES[name](spark, sf_dir).collect()
        assert sorted(r.doc_id for r in got) == sorted(docs)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % rest[0] == rest[1]) and 0 <= r.score <= 1 for r in got)
        if name == "op4_quality":
            assert all(r.predicted == int(r.score >= 0.3) for r in got)
        else:
            held = [r for r in got if r.held_out and docs[r.doc_id].lang and docs[r.doc_id].text]
            assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) > 0.9 * len(held)
    pages = {r.page_id: r for r in table(spark, sf_dir, "pages").collect()}
    got = QUERIES["op9_html"](spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url and "<" not in r.text for r in got) and all(r.text for r in got)


def test_registered_decontamination_equals_brute_force(spark, sf_dir):
    words = lambda t: [w for w in __import__("re").split(r"[\W_]+", (t or "").lower()) if w]
    items = [(r.item_id, words(r.text)) for r in table(spark, sf_dir, "benchmark").collect()]
    docs = [(r.doc_id, words(r.text)) for r in table(spark, sf_dir, "documents").where("length(text) < 3000 and doc_id < 40").collect()]
    grams = {}
    for item, w in items:
        for i in range(len(w) - 1):
            grams.setdefault((w[i], w[i + 1]), set()).add(item)
    expected = set()
    for doc, w in docs:
        near = {}
        for pair in zip(w, w[1:]):
            for item in grams.get(pair, ()):
                near[item] = near.get(item, 0) + 1
        expected |= {(doc, item) for item, held in items if near.get(item, 0) >= 3 and overlap(w, held)}
    few = {d for d, _ in docs}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, sf_dir).collect() if r.doc_id in few} == expected


def test_near_duplicates_keep_the_least_of_each_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if alike(rows[i][1], rows[j][1])]
    roots = union_find(range(len(rows)), links)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[roots[i]] = min(doc, least.get(roots[i], doc))
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()} == set(least.values())
