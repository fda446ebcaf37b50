"""The driver contract: every query runs and equals its SQL where it has one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from foliospark.plans.oracles import ORACLE_SQL
from foliospark.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLE_SQL:
        res = con.sql(ORACLE_SQL[name])
        assert sorted(res.columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(res.columns, res.fetchall())
    else:
        assert got


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert QUERIES.keys() <= entry.queries().keys()
