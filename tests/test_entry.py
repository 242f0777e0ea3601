"""The driver's contract: every query runs, and equals its SQL where it has one."""

import duckdb
import pytest

import __spark_entry__ as entry
from codeweft import queries as core

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return con


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted([columns[i] for i in order]), sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_core_query(spark, duck, name):
    df = core.QUERIES[name](spark, D)
    rows = [tuple(r) for r in df.collect()]
    if name in core.SQL:
        want = duck.sql(core.SQL[name])
        assert shown(rows, df.columns) == shown(want.fetchall(), want.columns)


def test_contract(spark):
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
