"""Every query with SQL agrees with DuckDB at the smallest scale; the catalogue is whole."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from laminar import oracles, queries


def _one(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6f}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(oracles.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_sql(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    made = duck.execute(entry.oracle_sql()[name])
    want = canonical([c[0] for c in made.description], made.fetchall())
    assert canonical(df.columns, df.collect()) == want
