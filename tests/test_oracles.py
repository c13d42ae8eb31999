"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import decimal
import math

import pytest
from conftest import SF

from commerce_lake.plans import ORACLES, QUERIES


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return str(x.normalize())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


#: Queries whose hard cases only the larger tables have.
LARGER = ("merge_filters", "expand_synonyms")


@pytest.mark.parametrize("name", LARGER)
def test_query_on_larger_tables(name, spark):
    import duckdb
    from conftest import TABLES

    con = duckdb.connect()
    folder = SF.replace("sf0.001", "sf0.01")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    compare(name, spark, con, folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    compare(name, spark, duck, SF)


def compare(name, spark, duck, folder):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert columns
        return
    r = duck.execute(ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(v) for _, v in sorted(zip(names, row))) for row in r.fetchall()), key=repr)
    assert got == want
