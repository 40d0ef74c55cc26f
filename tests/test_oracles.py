"""Every registered query against its SQL, on whole tables, order aside."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from waybill.plans.catalog import QUERIES
from waybill.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return float(f"{v:.12g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def key(row):
    return tuple((v is None, str(type(v)), "" if v is None else str(v)) for v in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    assert got, "a query without rows shows nothing"
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w
