"""Queries that SQL can express, against DuckDB on whole tables."""

import duckdb
import pytest

from waybill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]}) ORDER BY ALL").fetchall()
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(want) and got
