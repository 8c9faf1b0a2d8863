"""Every query of the subpackage runs, and agrees with its SQL where it has some."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
LLM = sorted(n for n, f in QUERIES.items() if f.__module__.startswith("strataspark.llm"))


@pytest.mark.parametrize("name", LLM)
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for p in Path(small).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        cursor = con.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(cursor.fetchall())


def test_columns(spark, small):
    want = {
        "p3_found": ["file_id"],
        "p4_found": ["file_id", "start_pos", "end_pos"],
        "p5_found": ["request_id", "file_id"],
        "p6_ids": ["doc_id", "ids"],
        "p8_found": ["doc_id", "start_pos", "end_pos"],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, small).columns == columns
