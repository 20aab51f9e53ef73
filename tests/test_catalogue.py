"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([str(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_equals_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    expected = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert plain(df.columns, df.collect()) == plain(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", ["platt_map", "gbt_scores", "gbt_importances", "stacked_scores", "gbt_curve", "frozen_nodes", "final_test", "live_scores"])
def test_runs(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
