"""Search documents, counted precomputes, delta maintenance and versions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, fold

WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def live(df: DataFrame) -> DataFrame:
    return df.where("deleted_at is null")


def variant_agg(variants: DataFrame) -> DataFrame:
    """One row for each product: variants in position order (nulls last), sku text, price range, availability."""
    key = F.struct(F.col("position").isNull().alias("no_position"), "position", "variant_gid", "sku", "title", "price", F.coalesce("available_for_sale", F.lit(False)).alias("available"))
    a = live(variants).groupBy("product_id").agg(
        F.array_sort(F.collect_list(key)).alias("v"), F.min("price").alias("price_min"), F.max("price").alias("price_max"), F.bool_or(F.coalesce("available_for_sale", F.lit(False))).alias("available"), F.count("*").alias("variant_count")
    )
    return a.select("product_id", F.transform("v", lambda x: x.dropFields("no_position")).alias("variants"), F.array_join("v.sku", " ").alias("sku_text"), F.array_join("v.title", " ").alias("variant_titles"), "price_min", "price_max", "available", "variant_count")


def collection_agg(memberships: DataFrame, collections: DataFrame) -> DataFrame:
    """Live collection titles of each product, in order."""
    m = memberships.join(live(collections).select("collection_gid", "title"), "collection_gid")
    return m.groupBy("product_id").agg(F.sort_array(F.collect_set("title")).alias("collections"))


def parent_agg(products: DataFrame, variants: DataFrame) -> DataFrame:
    """For each parent gid: number of visible children and their price range, of available variants if any child has one."""
    child = live(products).where("combined_role = 'CHILD' and status = 'ACTIVE' and online_store_url is not null").select("product_id", F.col("combined_parent_gid").alias("gid"))
    v = child.join(live(variants).select("product_id", "price", "available_for_sale"), "product_id", "left")
    open_price = F.when(F.col("available_for_sale"), F.col("price"))
    a = v.groupBy("gid").agg(F.count_distinct("product_id").alias("child_count"), F.min(open_price).alias("a0"), F.max(open_price).alias("a1"), F.min("price").alias("p0"), F.max("price").alias("p1"))
    return a.select("gid", "child_count", F.coalesce("a0", "p0").alias("child_price_min"), F.coalesce("a1", "p1").alias("child_price_max"))


def build_search_docs(products: DataFrame, variants: DataFrame, memberships: DataFrame, collections: DataFrame, version: int = 1) -> DataFrame:
    """One document for each live product: each child table is aggregated to the product key, then joined."""
    products = products if "description" in products.columns else products.withColumn("description", F.lit(None).cast("string"))
    d = live(products).join(variant_agg(variants), "product_id", "left").join(collection_agg(memberships, collections), "product_id", "left").join(parent_agg(products, variants), "gid", "left")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    titles = F.coalesce("collections", F.array().cast("array<string>"))
    text = F.trim(F.concat_ws(" ", "title", "vendor", "product_type", "sku_text", F.array_join(tags, " "), "variant_titles", F.array_join(titles, " ")))
    card = F.to_json(F.struct("title", "handle", "vendor", "product_type", "price_min", "price_max", "available", "child_count", "child_price_min", "child_price_max", "variants"))
    return d.select(
        "tenant_id", F.lit(version).alias("index_version"), "product_id", "gid", "handle", "title", "vendor", "product_type", tags.alias("tags"), titles.alias("collections"), "status", F.col("online_store_url").isNotNull().alias("published"),
        F.coalesce("available", F.lit(False)).alias("available"), "price_min", "price_max", "sku_text", "variant_titles", "metafields", "description", "combined_role", F.coalesce("child_count", F.lit(0)).alias("child_count"), "child_price_min", "child_price_max",
        text.alias("search_text"), F.md5(card).alias("content_hash"),
    )


def visible(docs: DataFrame, active: DataFrame | None = None) -> DataFrame:
    out = docs.where("published and status = 'ACTIVE'")
    return out if active is None else out.join(active, ["tenant_id", "index_version"], "left_semi")


def tokens_of(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def analyze_terms(docs: DataFrame) -> DataFrame:
    """Postings: product_id, term, weight, n. A title; B vendor, type, sku; C tags, variants, collections; D description."""

    fields = {"A": "title", "B": F.concat_ws(" ", "vendor", "product_type", "sku_text"), "C": F.concat_ws(" ", F.array_join("tags", " "), "variant_titles", F.array_join("collections", " "))}
    if "description" in docs.columns:
        fields["D"] = F.coalesce("description", F.lit(""))

    def weighed(field: str, c) -> Column:
        return F.transform(tokens_of(F.col(c) if isinstance(c, str) else c), lambda t: F.struct(t.alias("term"), F.lit(WEIGHTS[field]).alias("weight")))

    parts = F.flatten(F.array(*[weighed(field, c) for field, c in fields.items()]))
    return docs.select("product_id", F.explode(parts).alias("p")).groupBy("product_id", "p.term", "p.weight").agg(F.count("*").alias("n"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """term, doc_freq, is_numeric of ASCII tokens of at least two characters; one partial count, no distinct count."""
    terms = F.array_distinct(F.regexp_extract_all(fold(F.col("search_text")), F.lit("[a-z0-9]+"), F.lit(0)))
    t = docs.select(F.explode(terms).alias("term")).where("length(term) >= 2").groupBy("term").agg(F.count("*").alias("doc_freq"))
    return t.withColumn("is_numeric", F.col("term").rlike("^[0-9]+$"))


def facet_pairs(metafield: str = "custom.size") -> Column:
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    keep = lambda kind, c: F.when(c.isNotNull() & (c != ""), F.array(pair(kind, c))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    tags = F.transform(F.filter("tags", lambda t: t.isNotNull()), lambda t: pair("tag", t))
    return F.flatten(F.array(keep("vendor", F.col("vendor")), keep("product_type", F.col("product_type")), tags, keep("metafield", F.element_at("metafields", metafield)), keep("available", F.col("available").cast("string"))))


def facet_values(docs: DataFrame) -> DataFrame:
    """kind, value, n from one scan; a tag that a document repeats counts again."""
    return docs.select(F.explode(facet_pairs()).alias("p")).groupBy("p.kind", "p.value").agg(F.count("*").alias("n"))


def facet_summary(docs: DataFrame) -> DataFrame:
    return docs.agg(F.min("price_min").alias("price_min"), F.max("price_max").alias("price_max"), F.count("*").alias("n"))


def suggest_terms(docs: DataFrame) -> DataFrame:
    one = lambda kind, c: F.array(F.struct(F.lit(kind).alias("type"), F.col(c).alias("text")))
    pairs = F.flatten(F.array(one("title", "title"), one("vendor", "vendor"), one("productType", "product_type"), F.transform("collections", lambda c: F.struct(F.lit("collection").alias("type"), c.alias("text")))))
    return docs.select(F.explode(pairs).alias("p")).where("p.text is not null and p.text <> ''").groupBy("p.type", "p.text").agg(F.count("*").alias("n"))


def parse_values(facets: DataFrame) -> DataFrame:
    return facets.where("not (kind = 'tag' and value = '')").groupBy("kind").agg(F.sort_array(F.collect_set("value")).alias("values"))


def apply_delta(counted: DataFrame, old: DataFrame, new: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Counters after documents changed: counted - old + new, rows at or below zero removed; one aggregation."""
    signed = counted.select(*keys, count).unionByName(new.select(*keys, count)).unionByName(old.select(*keys, (-F.col(count)).alias(count)))
    return signed.groupBy(*keys).agg(F.sum(count).alias(count)).where(F.col(count) > 0)


def apply_summary_delta(summary: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Range and count after a change; price_dirty when a removed document may have held an extreme."""
    o, n = facet_summary(old), facet_summary(new)
    j = summary.join(o.toDF("o_min", "o_max", "o_n"), how="cross").join(n.toDF("n_min", "n_max", "n_n"), how="cross")  # one row each
    dirty = F.coalesce((F.col("o_min") <= F.col("price_min")) | (F.col("o_max") >= F.col("price_max")), F.lit(False))
    return j.select(F.least("price_min", "n_min").alias("price_min"), F.greatest("price_max", "n_max").alias("price_max"), (F.col("n") - F.col("o_n") + F.col("n_n")).alias("n"), dirty.alias("price_dirty"))


def effective_summary(summary: DataFrame, docs: DataFrame) -> DataFrame:
    """The stored range while clean, the live one otherwise."""
    fresh = facet_summary(docs).select(F.col("price_min").alias("m0"), F.col("price_max").alias("m1"))
    pick = lambda a, b: F.when(F.col("price_dirty"), F.col(b)).otherwise(F.col(a)).alias(a)
    return summary.join(fresh, how="cross").select(pick("price_min", "m0"), pick("price_max", "m1"), "n")


def signature(df: DataFrame) -> DataFrame:
    """An order-free signature of a table: number of rows and sum of row hashes."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("hash"))


def drift_report(kept: dict[str, DataFrame], rebuilt: dict[str, DataFrame]) -> DataFrame:
    """Which structures differ from a rebuild."""
    out = None
    for name in sorted(kept):
        a, b = signature(kept[name]), signature(rebuilt[name].select(*kept[name].columns))
        row = a.join(b.toDF("rows_b", "hash_b"), how="cross").select(F.lit(name).alias("structure"), (~(F.col("rows").eqNullSafe(F.col("rows_b")) & F.col("hash").eqNullSafe(F.col("hash_b")))).alias("differs"))
        out = row if out is None else out.unionByName(row)
    return out


def refresh_docs(docs: DataFrame, changed: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """docs with the changed products replaced by their rebuilt documents; those without one go."""
    return docs.join(changed, "product_id", "left_anti").unionByName(rebuilt.join(changed, "product_id", "left_semi"))


def catch_up(docs: DataFrame, products: DataFrame, rebuild: Callable[[DataFrame], DataFrame], snapshot: datetime, margin: timedelta = timedelta(seconds=5)) -> DataFrame:
    """A build's documents brought up to date: products changed since its snapshot, less a margin for clocks, are projected again.

    products have updated_at; rebuild makes the documents of the products it is given. Deleted products lose theirs."""
    changed = products.where(F.col("updated_at") >= F.lit(snapshot - margin))
    return refresh_docs(docs, changed.select("product_id").distinct(), rebuild(live(changed)))


def refresh_parents(docs: DataFrame, products: DataFrame, variants: DataFrame, memberships: DataFrame, collections: DataFrame, changed: DataFrame) -> DataFrame:
    """docs with the parents of the changed products (product_id) projected again, from their children as they are now."""
    gids = products.join(changed.select("product_id"), "product_id", "left_semi").where("combined_parent_gid is not null").select(F.col("combined_parent_gid").alias("parent_gid")).distinct()
    parents = products.join(gids, F.col("gid") == F.col("parent_gid"), "left_semi")
    children = products.join(gids, F.col("combined_parent_gid") == F.col("parent_gid"), "left_semi")
    family = parents.unionByName(children).dropDuplicates(["product_id"])
    of = lambda df: df.join(family.select("product_id"), "product_id", "left_semi")
    rebuilt = build_search_docs(family, of(variants), of(memberships), collections)
    return refresh_docs(docs, parents.select("product_id"), rebuilt.select(docs.columns))


def count_stale_roles(docs: DataFrame, products: DataFrame) -> DataFrame:
    """Documents without a role whose product has one."""
    j = docs.where("combined_role is null").join(live(products).where("combined_role is not null").select("product_id"), "product_id", "left_semi")
    return j.agg(F.count("*").alias("stale"))


def validate_build(docs: DataFrame, products: DataFrame, expected: int | None = None) -> DataFrame:
    d, p = docs.agg(F.count("*").alias("docs")), live(products).agg(F.count("*").alias("live"))
    enough = F.lit(True) if expected is None else F.col("live") >= expected
    failed = F.greatest(F.col("live") - F.col("docs"), F.lit(0))
    return d.join(p, how="cross").select("docs", "live", ((F.col("docs") == F.col("live")) & enough).alias("valid"), failed.alias("failed"))


# ---- versions: a small table (tenant_id, version, status)


def publish_versions(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Activates each tenant's wanted version (tenant_id, version) if it is validated, and supersedes the active one; anything else changes nothing."""
    j = versions.join(wanted.groupBy("tenant_id").agg(F.max("version").alias("_wanted")), "tenant_id", "left")
    chosen = F.coalesce(F.col("version") == F.col("_wanted"), F.lit(False))
    ready = F.max(chosen & (F.col("status") == "validated")).over(Window.partitionBy("tenant_id"))
    status = F.when(F.col("_ready") & chosen, "active").when(F.col("_ready") & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    return j.withColumn("_ready", ready).withColumn("status", status).select(versions.columns)


def publish_version(versions: DataFrame, tenant: str, version: int) -> DataFrame:
    """publish_versions for one tenant."""
    return publish_versions(versions, versions.where((F.col("tenant_id") == tenant) & (F.col("version") == version)).select("tenant_id", "version"))


def new_versions(versions: DataFrame, tenants: DataFrame) -> DataFrame:
    """versions with a new one to build for each installed tenant (tenant_id, uninstalled_at), after its last."""
    last = versions.groupBy("tenant_id").agg(F.max("version").alias("_last"))
    new = tenants.where("uninstalled_at is null").select("tenant_id").distinct().join(last, "tenant_id", "left")
    return versions.unionByName(new.select("tenant_id", (F.coalesce("_last", F.lit(0)) + 1).cast(versions.schema["version"].dataType).alias("version"), F.lit("building").alias("status")))


def rollback_version(versions: DataFrame, tenant: str) -> DataFrame:
    """Activates the newest eligible version below the active one."""
    w = Window.partitionBy("tenant_id")
    active = F.max(F.when(F.col("status") == "active", F.col("version"))).over(w)
    target = F.max(F.when(F.col("status").isin("superseded", "validated", "rolled_back") & (F.col("version") < F.col("_active")), F.col("version"))).over(w)
    v = versions.withColumn("_active", active)
    v = v.withColumn("_target", target)
    mine = (F.col("tenant_id") == tenant) & F.col("_target").isNotNull()
    return v.withColumn("status", F.when(mine & (F.col("version") == F.col("_target")), "active").when(mine & (F.col("version") == F.col("_active")), "rolled_back").otherwise(F.col("status"))).drop("_active", "_target")


def active_versions(versions: DataFrame) -> DataFrame:
    return versions.where("status = 'active'").select("tenant_id", F.col("version").alias("index_version"))


def prune_versions(versions: DataFrame, keep: int = 2) -> DataFrame:
    """Keeps active versions and the newest inactive ones."""
    w = Window.partitionBy("tenant_id", F.col("status") == "active").orderBy(F.desc("version"))
    return versions.withColumn("_r", F.row_number().over(w)).where((F.col("status") == "active") | (F.col("_r") <= keep)).drop("_r")


def recover_incomplete(versions: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks unfinished versions failed and removes their documents."""
    unfinished = F.col("status").isin("building", "validating")
    bad = versions.where(unfinished).select("tenant_id", F.col("version").alias("index_version"))
    return versions.withColumn("status", F.when(unfinished, "failed").otherwise(F.col("status"))), docs.join(bad, ["tenant_id", "index_version"], "left_anti")
