"""The document store: readers see whole versions of their own tenant, before and after each switch."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from commerce_lake.sources.doc_store import DocumentStore

DOCS = "tenant_id string, index_version int, product_id string, title string"


@pytest.fixture
def store(spark, tmp_path):
    return DocumentStore(spark, f"file://{tmp_path}/store", spark.createDataFrame([], DOCS).schema)


def docs(spark, version, title, ids=("1", "2"), tenants=("007", "7")):
    return spark.createDataFrame([(t, version, i, f"{title} {t}") for t in tenants for i in ids], DOCS)


def products(spark, ids=("1", "2"), gone=()):
    return spark.createDataFrame([(t, i, i in gone) for t in ("007", "7") for i in ids], "tenant_id string, product_id string, gone boolean").withColumn("deleted_at", F.when(F.col("gone"), F.current_timestamp())).drop("gone")


def wanted(spark, version, tenants=("007", "7")):
    return spark.createDataFrame([(t, version) for t in tenants], "tenant_id string, version int")


def seen(df):
    return sorted((r.tenant_id, r.index_version, r.product_id, r.title) for r in df.collect())


def rows(version, title, ids=("1", "2"), tenants=("007", "7")):
    return sorted((t, version, i, f"{title} {t}") for t in tenants for i in ids)


def test_switch_rollback_prune(spark, store, tmp_path):
    assert seen(store.read()) == [] and store.vacuum() == 0
    p = products(spark)
    store.build(docs(spark, 1, "a"), p, wanted(spark, 1))
    assert seen(store.read()) == []  # built, not published
    store.publish(wanted(spark, 1))
    before = store.read()
    assert seen(before) == rows(1, "a")
    assert {r.status for r in store.build(docs(spark, 2, "b"), p, wanted(spark, 2)).collect()} == {"validated"}
    store.publish(wanted(spark, 2, ["007"]))  # one tenant only
    assert seen(before) == rows(1, "a")  # an open reader keeps its version
    assert seen(store.read()) == sorted(rows(2, "b", tenants=["007"]) + rows(1, "a", tenants=["7"]))
    store.rollback("007")
    assert seen(store.read()) == rows(1, "a")
    store.build(docs(spark, 3, "c"), p, wanted(spark, 3))
    store.publish(wanted(spark, 3))
    store.prune(keep=0)
    assert seen(store.read()) == rows(3, "c")
    left = {f.parent.relative_to(tmp_path / "store/documents").as_posix() for f in Path(tmp_path / "store/documents").rglob("*.parquet")}
    assert {x.rsplit("/", 1)[0] for x in left} == {"tenant_id=007/index_version=3", "tenant_id=7/index_version=3"}


def test_failed_and_dead_builds(spark, store):
    p = products(spark)
    store.build(docs(spark, 1, "a"), p, wanted(spark, 1))
    store.publish(wanted(spark, 1))
    for bad in (docs(spark, 2, "b", ["1"]), docs(spark, 2, "b", ["1", "1"]), docs(spark, 2, "b", [])):
        assert {r.status for r in store.build(bad, p, wanted(spark, 2)).collect()} == {"failed"}
        store.publish(wanted(spark, 2))
        assert seen(store.read()) == rows(1, "a")
    assert store.build(docs(spark, 1, "x"), p, wanted(spark, 1)).count() == 0  # an active version stays
    store._append(wanted(spark, 4).selectExpr("*", "'building' AS status", "99L AS generation"))  # as a dead job leaves it
    store.recover()
    assert {r.status for r in store.versions().where("version = 4").collect()} == {"failed"}
    store.vacuum()
    assert seen(store.read()) == rows(1, "a")


def test_reproject(spark, store):
    store.build(docs(spark, 1, "a"), products(spark), wanted(spark, 1))
    store.publish(wanted(spark, 1, ["007"]))
    before = store.read()
    again = lambda live: live.selectExpr("tenant_id", "0 AS index_version", "product_id", "concat('z ', tenant_id) AS title")
    store.reproject(products(spark, gone=("2",)), again)
    assert seen(before) == rows(1, "a", tenants=["007"]) and seen(store.read()) == rows(1, "z", ["1"], ["007"])
    assert seen(store.read("validated")) == rows(1, "a", tenants=["7"])  # other versions stay
    store.reproject(products(spark, gone=("1", "2")), again)
    assert seen(store.read()) == []
    assert store.vacuum() == 2 and seen(store.read()) == []
