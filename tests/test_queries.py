"""Every query of the search index against DuckDB on the same tables."""

import os

import duckdb
import pytest

from lodestone.plans import index_queries  # noqa: F401
from lodestone.plans.queries import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITHOUT_SQL = {"kmeans_train", "rabitq_search"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


def test_only_these_have_no_sql():
    assert QUERIES.keys() - ORACLES.keys() == WITHOUT_SQL


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in got.collect()]
    said = duck.execute(ORACLES[name])
    columns = [c[0] for c in said.description]
    assert sorted(got.columns) == sorted(columns)
    assert comparable(rows, got.columns) == comparable(said.fetchall(), columns)
