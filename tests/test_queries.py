"""Every reference query against its SQL twin on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans import banded, braced, extra, more, results, streams  # noqa: F401
from quarry.plans import queries as q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_twin(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    told = duck.sql(q.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(told.columns) == columns
    kinds = dict(zip(told.columns, map(str, told.types), strict=True))
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    ours = sorted((tuple(repr(r[c]) for c in columns) for r in df.collect()))
    theirs = sorted((tuple(repr(dict(zip(told.columns, r, strict=True))[c]) for c in columns) for r in told.fetchall()))
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
