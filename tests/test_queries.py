"""Every query of the library against its SQL oracle in DuckDB."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ticketloom.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else round(float(v), 9)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_every_query_has_an_oracle():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "agent", "email", "active", "pending", "closed"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_oracle_is_empty():
    """Rows on both sides, so that an equal result shows something."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    at = SF.replace("sf0.001", "sf0.01")
    for f in os.listdir(at):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{at}/{f}'")
    empty = [name for name, sql in queries.ORACLE_SQL.items() if not con.sql(sql).limit(1).fetchall()]
    assert not empty
