"""Order-safe merges, reconciliation and change propagation on plain tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ID = r"^gid://[A-Za-z]+/([^/]+)/"


def gid_type(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, _ID, 1), F.lit(""))


def monotonic_upsert(target: DataFrame, updates: DataFrame, keys: list[str], version: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """target after updates of the same columns: a row is replaced unless it is newer; a missing version on either side applies.

    Several updates of a key count once, the latest.  keep_old: columns whose old value stays
    where the new one is null.  A replaced row is live again.  The result tells ``applied``."""
    latest = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_first())
    new = updates.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")
    rest = [c for c in target.columns if c not in keys]
    old_ = target.select(*keys, F.struct(*rest).alias("o"), F.lit(True).alias("has_o"))
    new_ = new.select(*keys, F.struct(*rest).alias("n"), F.lit(True).alias("has_n"))
    j = old_.join(new_, keys, "full_outer")
    newer = F.col(f"o.{version}").isNull() | F.col(f"n.{version}").isNull() | (F.col(f"n.{version}") >= F.col(f"o.{version}"))
    applied = F.col("has_n").isNotNull() & (F.col("has_o").isNull() | newer)

    def value(c: str) -> Column:
        fresh = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_old else F.col(f"n.{c}")
        return F.when(applied, F.lit(None).cast(target.schema[c].dataType) if c == "deleted_at" else fresh).otherwise(F.col(f"o.{c}")).alias(c)

    return j.select(*keys, *map(value, rest), applied.alias("applied"))


def _bury(df: DataFrame, when: Column, now: datetime) -> DataFrame:
    out = df
    for c in ("deleted_at", "updated_at", "source_updated_at"):
        if c in df.columns:
            out = out.withColumn(c, F.when(when, F.lit(now)).otherwise(df[c]))
    return out


def tombstone(target: DataFrame, keys: DataFrame, on: list[str], now: datetime) -> DataFrame:
    """Marks live rows with these keys deleted now, so that an older upsert cannot revive them."""
    j = target.join(keys.select(*on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return _bury(j, F.col("_hit").isNotNull() & F.col("deleted_at").isNull(), now).select(*target.columns)


def reconcile_children(target: DataFrame, keep: DataFrame, parents: DataFrame, key: str, parent: str, now: datetime) -> DataFrame:
    """Buries live children, of parents whose children are known completely, that are not among ``keep``."""
    j = target.join(parents.select(parent).distinct().withColumn("_p", F.lit(True)), parent, "left").join(keep.select(key).distinct().withColumn("_k", F.lit(True)), key, "left")
    return _bury(j, F.col("_p").isNotNull() & F.col("_k").isNull() & F.col("deleted_at").isNull(), now).select(*target.columns)


def replace_memberships(target: DataFrame, incoming: DataFrame, collections: DataFrame, touched: DataFrame) -> DataFrame:
    """The memberships of touched products become the incoming ones in known collections."""
    known = incoming.join(collections.select("collection_gid").distinct(), "collection_gid", "left_semi").select(*target.columns).distinct()
    return target.join(touched.select("product_id").distinct(), "product_id", "left_anti").select(*target.columns).unionByName(known)


def reconcile_snapshot(target: DataFrame, snapshot: DataFrame, on: list[str], started: datetime, now: datetime) -> DataFrame:
    """Buries live rows that are absent from a snapshot and were last updated before it started."""
    j = target.join(snapshot.select(*on).distinct().withColumn("_s", F.lit(True)), on, "left")
    return _bury(j, F.col("_s").isNull() & F.col("deleted_at").isNull() & (F.col("updated_at") < F.lit(started)), now).select(*target.columns)


def large_deletion_check(prior: Column, deleted: Column) -> Column:
    return (deleted >= 5) & (deleted >= 0.5 * prior)


def affected_products(products: DataFrame, collections: DataFrame, variants: DataFrame, memberships: DataFrame, before: DataFrame) -> DataFrame:
    """Products that changes touch: their own, members of changed collections, new and former parents of changed variants."""
    own = products.select("product_id")
    members = memberships.join(collections.select("collection_gid"), "collection_gid", "left_semi").select("product_id")
    now = variants.select("product_id")
    former = before.join(variants.select("variant_gid"), "variant_gid", "left_semi").select("product_id")
    return own.unionByName(members).unionByName(now).unionByName(former).where("product_id is not null").distinct()


def map_change_events(df: DataFrame) -> DataFrame:
    """topic, resource_gid, delivery_id -> entity, gid, dedupe_key; other topics and rows without an id go."""
    topic = F.upper(F.replace(F.col("topic"), F.lit("/"), F.lit("_")))
    entity = F.when(topic.startswith("PRODUCTS_"), "product").when(topic.startswith("COLLECTIONS_"), "collection")
    return df.select(entity.alias("entity"), F.col("resource_gid").alias("gid"), F.concat_ws(":", topic, "delivery_id").alias("dedupe_key")).where("entity is not null and gid is not null")


def dedupe_deliveries(df: DataFrame, ledger: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first delivery of each key that is not completed yet; failed ones come again."""
    w = Window.partitionBy(*key).orderBy(order)
    todo = df.join(ledger.where("status = 'completed'").select(*key).distinct(), key, "left_anti")
    return todo.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def stale_tenants(tenants: DataFrame, now: datetime, hours: int) -> DataFrame:
    """Installed tenants never synchronised or not within the interval; 0 takes all."""
    old = F.col("last_full_sync_at").isNull() | (F.col("last_full_sync_at") <= F.lit(now) - F.make_dt_interval(hours=F.lit(hours)))
    return tenants.where("uninstalled_at is null").where(old if hours else F.lit(True))


def installed_only(df: DataFrame, tenants: DataFrame) -> DataFrame:
    return df.join(tenants.where("uninstalled_at is null").select("tenant_id"), "tenant_id", "left_semi")


def count_live(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count("*").alias("all_rows"))


def catalog_status_counts(products: DataFrame, variants: DataFrame, docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    d = dictionary.agg(F.count_if(F.col("locale").isNull()).alias("global_rows"), F.count_if(F.col("locale").isNotNull()).alias("locale_rows"))
    out = one(products.where("deleted_at is null"), "products")
    for other in (one(variants.where("deleted_at is null"), "variants"), one(docs.where("published and status = 'ACTIVE'"), "visible_docs"), d):
        out = out.join(other, how="cross")  # one row each
    return out
