"""Baskets of any size count for frequently bought partners."""

from collections import Counter
from itertools import combinations_with_replacement

from commerce_lake.operators import recommend as R
from commerce_lake.plans import ORACLES, QUERIES


def sample(spark):
    """One basket of 150 products, one of 64, one of 65, small ones; repeated lines and a product that is not shown."""
    held = {1: range(150), 2: range(64), 3: range(100, 165), 4: (3, 5), 5: (7,), 6: (3, 5, 149)}
    rows = [(b, f"p{p:03}") for b, ps in held.items() for p in ps] + [(4, "p003"), (4, "gone"), (7, "gone")]
    docs = spark.createDataFrame([(f"p{p:03}", f"title {p}") for p in range(165)], "product_id string, title string")
    return held, spark.createDataFrame(rows, "basket_id long, product_id string"), docs


def test_large_baskets_are_paired_whole(spark):
    held, baskets, docs = sample(spark)
    want = Counter((f"p{a:03}", f"p{b:03}") for ps in held.values() for a, b in combinations_with_replacement(ps, 2))
    got = R.build_cooccurrence(baskets, docs, None).collect()
    assert {(r.a, r.b): r.n for r in got} == want and len(got) == len(want)
    assert R.basket_count(baskets, docs, None).first()[0] == 6
    assert R.basket_count(baskets, docs).first()[0] == 3


def test_frequently_bought_counts_large_baskets(spark, tmp_path):
    """A basket of every product, by the query's SQL as well."""
    import duckdb

    from conftest import SF, TABLES

    con = duckdb.connect()
    for t in TABLES:
        source = f"read_parquet('{SF}/{t}.parquet')"
        more = f"SELECT * FROM {source} UNION ALL SELECT l.* REPLACE (-1 AS l_orderkey) FROM {source} l WHERE l_partkey < 90" if t == "lineitem" else f"SELECT * FROM {source}"
        con.execute(f"COPY ({more}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    assert con.execute("SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = -1").fetchone()[0] > 64
    df = QUERIES["frequently_bought"](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['frequently_bought']})").fetchall()
    assert got == sorted(want) and len(got) > 100
