"""Product nodes as a catalog API returns them: typed JSON with nested lists in one of three forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events_in import flatten_metafields

#: The roles of a combined listing that count.
ROLES = ("PARENT", "CHILD")


def _kind(v: Column) -> Column:
    """The type of a VARIANT value; VOID for a missing one and for JSON's null."""
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _typed(v: Column, path: str, kinds: str, as_type: str) -> Column:
    """The value at a path if it has one of the kinds, else null: the text "3" is no number."""
    return F.when(_kind(_get(v, path, "variant")).rlike(f"^({kinds})"), _get(v, path, as_type))


_NUMBER = "BIGINT|DECIMAL|DOUBLE|FLOAT"


def connection(node: Column, field: str) -> Column:
    """The elements of a nested list, given as {nodes: [...]}, {edges: [{node: ...}]} or a plain array; empty if it is none of these."""
    at = f"$.{field}"
    edges = F.transform(_get(node, f"{at}.edges", "array<variant>"), lambda e: _get(e, "$.node", "variant"))
    found = F.coalesce(_get(node, at, "array<variant>"), _get(node, f"{at}.nodes", "array<variant>"), edges, F.array().cast("array<variant>"))
    return F.filter(found, lambda v: _kind(v) != "VOID")


def complete(node: Column, field: str) -> Column:
    """False only where the nested list tells that a further page exists."""
    return ~F.coalesce(_typed(node, f"$.{field}.pageInfo.hasNextPage", "BOOLEAN", "boolean"), F.lit(False))


def tag_list(node: Column) -> Column:
    """Tags of an array as they are, of a text its trimmed parts between commas; empty otherwise."""
    text = _typed(node, "$.tags", "STRING", "string")
    parts = F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")
    return F.coalesce(F.array_compact(_get(node, "$.tags", "array<string>")), parts, F.array().cast("array<string>"))


def metafields(node: Column, namespace: str = "custom") -> Column:
    """namespace.key -> value of one namespace's scalar values; the last of equal keys counts."""
    rows = F.transform(connection(node, "metafields"), lambda m: F.struct(_get(m, "$.namespace").alias("namespace"), _get(m, "$.key").alias("key"), _get(m, "$.value").alias("value")))
    rows = F.filter(rows, lambda m: (m["namespace"] == namespace) & m["key"].isNotNull() & m["value"].isNotNull())
    last = F.filter(rows, lambda m, i: ~F.exists(F.slice(rows, i + 2, F.greatest(F.size(rows), F.lit(1))), lambda o: o["key"] == m["key"]))
    return flatten_metafields(last, namespace)


def normalize_products(nodes: DataFrame, namespace: str = "custom") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, variants, memberships) of rows with one product each as JSON text in the column ``node``.

    Equal content gives equal rows in each form of its nested lists.  Values of another type than the field's count as missing.
    variants_complete and collections_complete are false where a list was cut off: its absent rows say nothing about deletions.
    Rows that are no JSON object with an id are dropped, as are nested elements that are null and collections without an id."""
    n = nodes.select(F.try_parse_json("node").alias("v")).withColumn("gid", _get(F.col("v"), "$.id")).where("gid is not null")
    v = F.col("v")
    role = _get(v, "$.combinedListingRole")
    text = {"handle": "handle", "title": "title", "description": "description", "vendor": "vendor", "productType": "product_type", "status": "status"}
    products = n.select(
        "gid", *[_get(v, f"$.{name}").alias(c) for name, c in text.items()], tag_list(v).alias("tags"), metafields(v, namespace).alias("metafields"),
        _get(v, "$.onlineStoreUrl").alias("online_store_url"), _get(v, "$.featuredImage.url").alias("image_url"), _get(v, "$.featuredImage.altText").alias("image_alt"),
        _typed(v, "$.totalInventory", _NUMBER, "long").alias("total_inventory"), _typed(v, "$.tracksInventory", "BOOLEAN", "boolean").alias("tracks_inventory"),
        _get(v, "$.createdAt", "timestamp").alias("created_at"), _get(v, "$.updatedAt", "timestamp").alias("source_updated_at"),
        F.when(role.isin(*ROLES), role).alias("combined_role"), _typed(v, "$.combinedListing.parentProduct.id", "STRING", "string").alias("combined_parent_gid"),
        complete(v, "variants").alias("variants_complete"), complete(v, "collections").alias("collections_complete"),
    )
    x = F.col("x")
    variants = n.select(F.col("gid").alias("product_gid"), F.explode(connection(v, "variants")).alias("x")).select(
        _get(x, "$.id").alias("variant_gid"), "product_gid", _get(x, "$.sku").alias("sku"), _get(x, "$.barcode").alias("barcode"), _get(x, "$.title").alias("title"),
        _get(x, "$.price").try_cast("decimal(12,2)").alias("price"), _get(x, "$.compareAtPrice").try_cast("decimal(12,2)").alias("compare_at_price"),
        _typed(x, "$.position", _NUMBER, "int").alias("position"), _typed(x, "$.availableForSale", "BOOLEAN", "boolean").alias("available_for_sale"),
    )
    memberships = n.select(F.col("gid").alias("product_gid"), F.explode(connection(v, "collections")).alias("x")).select("product_gid", _get(x, "$.id").alias("collection_gid"))
    return products, variants, memberships.where("collection_gid is not null").distinct()
