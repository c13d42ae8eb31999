"""Facets for more requests than the small tables hold, with wanted values that documents share or hold several of."""

import os

import duckdb
import pytest
from conftest import SF, TABLES
from pyspark.sql import functions as F
from test_oracles import plain

from commerce_lake.operators import search as S
from commerce_lake.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """The smallest tables with 1400 suppliers: 700 requests."""
    d = tmp_path_factory.mktemp("many")
    for t in TABLES:
        if t != "supplier":
            os.symlink(f"{SF}/{t}.parquet", d / f"{t}.parquet")
    s = spark.read.parquet(f"{SF}/supplier.parquet")
    kind = s.schema["s_suppkey"].dataType
    s = s.orderBy("s_suppkey").limit(1).crossJoin(spark.range(1, 1401)).withColumn("s_suppkey", F.col("id").cast(kind)).drop("id")
    s.coalesce(1).write.parquet(str(d / "supplier.parquet"))
    return d


@pytest.mark.parametrize("name", ["facet_filter", "facets", "price_range_facet"])
def test_every_request_is_answered(name, spark, many):
    con = duckdb.connect()
    for t in ("part", "supplier", "lineitem", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{many}/{t}.parquet{'/*.parquet' if (many / f'{t}.parquet').is_dir() else ''}')")
    r = con.execute(ORACLES[name])
    names = [c[0] for c in r.description]
    want = sorted((tuple(plain(row[c]) for c in sorted(names)) for row in (dict(zip(names, v)) for v in r.fetchall())), key=repr)
    df = QUERIES[name](spark, str(many))
    got = sorted((tuple(plain(x[c]) for c in sorted(df.columns)) for x in df.collect()), key=repr)
    assert sorted(names) == sorted(df.columns) and got == want
    assert df.select("query_id").distinct().count() > 500


def test_price_ranges_by_definition(spark):
    """Ranges that are open, meet prices exactly, hold nothing or have crossed ends, and documents without prices or with a price span."""
    prices = [(1, 1), (1, 5), (2, 2), (2, 9), (5, 5), (7, 9), (9, 9), (None, None)]
    rows = [(f"p{i}", f"v{i % 3}" if i % 5 else None, f"t{i % 2}", ["a", "b", "a"][: i % 4], None, i % 3 > 0, *prices[i % 8]) for i in range(60)]
    docs = spark.createDataFrame(rows, "product_id string, vendor string, product_type string, tags array<string>, metafield string, available boolean, price_min int, price_max int").withColumns(
        {c: F.col(c).cast("decimal(12,2)") for c in ("price_min", "price_max")}
    )
    ends = [None, 0.5, 1.0, 2.0, 4.5, 5.0, 9.0, 10.0]
    asked = [(f"{lo}-{hi}-{w}", w, lo, hi) for lo in ends for hi in ends for w in (None, True, False)]
    q = spark.createDataFrame(asked, "query_id string, want_available boolean, price_lo double, price_hi double")
    got = {(r.query_id, r.kind, r.value): r.n for r in S.facets(q, docs).collect()}
    want = {}
    for query, w, lo, hi in asked:
        for _, vendor, kind, tags, _, available, least, most in rows:
            if (lo is None or most is not None and most >= lo) and (hi is None or least is not None and least <= hi):
                cells = [("product_type", kind)] + [("vendor", vendor)] * (vendor is not None) + [("tag", t) for t in tags]
                cells = cells * (w is None or w == available) + [("available", str(available).lower())]
                for k, v in cells:
                    want[query, k, v] = want.get((query, k, v), 0) + 1
    assert got == want
