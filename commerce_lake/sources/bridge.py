"""The driver's tables in the engine's schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pid(key) -> F.Column:
    return F.lpad(F.col(key).cast("string"), 9, "0")


def title() -> F.Column:
    """The part's name, with accents for one in nine and in the plural for another."""
    k = F.col("p_partkey")
    return F.when(k % 9 == 4, F.replace("p_name", F.lit("e"), F.lit("é"))).when(k % 9 == 5, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_name"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.lit("t1").alias("tenant_id"), pid("p_partkey").alias("product_id"), F.concat(F.lit("gid://store/Product/"), F.col("p_partkey")).alias("gid"),
        F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey")).alias("handle"), title().alias("title"), F.concat(F.lit("Made for "), F.lower("p_type"), F.lit(" use, number "), F.col("p_partkey") % 7).alias("description"),
        F.col("p_brand").alias("vendor"), F.col("p_type").alias("product_type"), F.when(F.col("p_partkey") % 20 == 3, "DRAFT").otherwise("ACTIVE").alias("status"),
        F.concat(F.split("p_name", " "), F.array(F.concat(F.lit("size-"), F.col("p_size")))).alias("tags"),
        F.when(F.col("p_size") % 10 != 0, F.concat(F.lit("/products/"), F.col("p_partkey"))).alias("online_store_url"),
        F.create_map(F.lit("custom.size"), F.col("p_size").cast("string")).alias("metafields"), F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        F.when(F.col("p_partkey") % 50 == 1, "PARENT").when(F.col("p_partkey") % 50 == 2, "CHILD").alias("combined_role"),
        F.when(F.col("p_partkey") % 50 == 2, F.concat(F.lit("gid://store/Product/"), F.col("p_partkey") - 1)).alias("combined_parent_gid"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are dealt by product once; variants, their prices and what is told of a product need no further shuffle of them."""
    li = table(spark, sf_dir, "lineitem").withColumn("product_id", pid("l_partkey")).repartition("product_id")
    v = li.groupBy("product_id", "l_partkey", "l_suppkey").agg(F.bool_or(F.col("l_linestatus") == "O").alias("available_for_sale"), F.min("l_shipdate").alias("created_at"))
    part = table(spark, sf_dir, "part").select(pid("p_partkey").alias("product_id"), "p_retailprice").hint("shuffle_hash")
    return v.join(part, "product_id").select(
        F.lit("t1").alias("tenant_id"), F.concat_ws("-", F.lit("v"), F.col("l_partkey"), F.col("l_suppkey")).alias("variant_gid"), "product_id",
        F.concat_ws("-", F.lit("sku"), F.col("l_partkey"), F.col("l_suppkey")).alias("sku"), F.concat(F.lit("option "), F.col("l_suppkey")).alias("title"),
        (F.col("p_retailprice").cast("decimal(12,2)") + (F.col("l_suppkey") % 10)).cast("decimal(12,2)").alias("price"), F.col("l_suppkey").cast("int").alias("position"),
        "available_for_sale", "created_at", F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products in the collection of their suppliers' nation."""
    pairs = table(spark, sf_dir, "lineitem").select(pid("l_partkey").alias("product_id"), "l_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    of = pairs.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("product_id", "s_nationkey").repartition("product_id").distinct()
    return of.select("product_id", F.concat(F.lit("c"), F.col("s_nationkey")).alias("collection_gid"))


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), F.col("n_nationkey")).alias("collection_gid"), F.col("n_name").alias("title"), F.lit(None).cast("timestamp").alias("deleted_at"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket_id"), pid("l_partkey").alias("product_id"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The click stream: types, surfaces and arms follow from the table's own columns."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    one_of = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("k") % len(names) + 1).cast("int"))
    kind = (
        F.when(F.col("event_type") == "view", "search_performed")
        .when(F.col("event_type") == "click", one_of("result_click", "predictive_click", "suggestion_click", "recommendation_click"))
        .when(F.col("event_type") == "purchase", F.when(F.col("k") % 7 == 0, "bundle_add_to_cart").otherwise("add_to_cart_from_search"))
        .when(F.col("event_type") == "error", "search_zero_result")
        .otherwise(one_of("filter_applied", "filter_applied", "redirect_followed"))
    )
    e = e.withColumn("k", k)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("query_norm"))
    return e.join(part, "k", "left").select(
        F.lit("t1").alias("tenant_id"), "event_id", kind.alias("event_type"), F.col("ts").cast("timestamp").alias("occurred_at"), F.col("user_id").cast("string").alias("session_id"),
        "query_norm", pid("k").alias("product_id"), one_of("search_page", "predictive", "recommendation", "bundle", "redirect").alias("surface"), F.when(F.col("k") % 2 == 0, "A").otherwise("B").alias("variant"), "value", F.col("k"),
    )


#: The same tables as DuckDB common table expressions.
SQL = {
    "product": """product AS (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS product_id, p_partkey, 'gid://store/Product/' || p_partkey AS gid, replace(p_name, ' ', '-') || '-' || p_partkey AS handle,
 CASE p_partkey % 9 WHEN 4 THEN replace(p_name, 'e', 'é') WHEN 5 THEN p_name || 's' ELSE p_name END AS title, 'Made for ' || lower(p_type) || ' use, number ' || p_partkey % 7 AS description, p_brand AS vendor, p_type AS product_type, CASE WHEN p_partkey % 20 = 3 THEN 'DRAFT' ELSE 'ACTIVE' END AS status,
 list_concat(string_split(p_name, ' '), ['size-' || p_size]) AS tags, p_size % 10 <> 0 AS published, p_size, CAST(p_retailprice AS DECIMAL(12,2)) AS price,
 CASE WHEN p_partkey % 50 = 1 THEN 'PARENT' WHEN p_partkey % 50 = 2 THEN 'CHILD' END AS combined_role FROM part)""",
    "variant": """variant AS (SELECT lpad(l_partkey::VARCHAR, 9, '0') AS product_id, 'v-' || l_partkey || '-' || l_suppkey AS variant_gid, 'sku-' || l_partkey || '-' || l_suppkey AS sku, 'option ' || l_suppkey AS title,
 CAST(CAST(any_value(p_retailprice) AS DECIMAL(12,2)) + l_suppkey % 10 AS DECIMAL(12,2)) AS price, l_suppkey AS position, bool_or(l_linestatus = 'O') AS available_for_sale, min(l_shipdate) AS created_at
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, l_suppkey)""",
    "membership": """membership AS (SELECT DISTINCT lpad(l_partkey::VARCHAR, 9, '0') AS product_id, 'c' || s_nationkey AS collection_gid FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)""",
    "event": """event AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'search_performed' WHEN 'click' THEN (['result_click','predictive_click','suggestion_click','recommendation_click'])[k % 4 + 1]
 WHEN 'purchase' THEN CASE WHEN k % 7 = 0 THEN 'bundle_add_to_cart' ELSE 'add_to_cart_from_search' END WHEN 'error' THEN 'search_zero_result' ELSE CASE WHEN k % 3 = 2 THEN 'redirect_followed' ELSE 'filter_applied' END END AS event_type,
 ts AS occurred_at, user_id::VARCHAR AS session_id, p_name AS query_norm, k, lpad(k::VARCHAR, 9, '0') AS product_id, (['search_page','predictive','recommendation','bundle','redirect'])[k % 5 + 1] AS surface,
 CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS variant, value FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) LEFT JOIN part ON k = p_partkey)""",
}


def sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
