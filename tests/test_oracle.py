"""Every query with SQL against DuckDB on the smallest data; the rest must run."""

import decimal
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CORE = sorted(n for n, f in QUERIES.items() if not f.__module__.startswith("strataspark.llm"))


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def compare(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", CORE)
def test_query(spark, small, duck, name):
    if not os.path.isdir(small):
        pytest.skip("no test data here")
    compare(spark, small, duck, name)
