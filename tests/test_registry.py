"""Every registry query against its DuckDB oracle on the smallest tables,
plus the entry smoke check."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from vellum.plans.fixtures import TABLES
from vellum.plans.registry import QUERIES as REGISTERED

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_file_bound():
    assert not set(REGISTERED) - set(E.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query_matches_oracle(spark, duck, name):
    df = REGISTERED[name](spark, SF)
    got = df.collect()
    sql = E.oracle_sql()[name]
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, got) == _rows(rel.columns, rel.fetchall())


def test_entry_rebuilds_edited_table(spark):
    from vellum.plans import fixtures as fx
    out = E.entry(spark)
    edited = fx.derive(spark, SF, "edited")
    assert out.count() == edited.count()
    assert out.exceptAll(edited).isEmpty() and edited.exceptAll(out).isEmpty()
