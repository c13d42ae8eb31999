"""Event validation, mapping and writing; bulk catalog files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.privacy import MARK, clean_query, redact_each, safe_cell
from ..operators.catalog import gid_type

#: The event types, surfaces, variants and keys that are taken, and their limits.
EVENT_TYPES = (
    "search_performed", "search_zero_result", "result_click", "predictive_click", "suggestion_click",
    "redirect_followed", "add_to_cart_from_search", "recommendation_click", "bundle_add_to_cart", "filter_applied",
)
SURFACES = ("search_page", "predictive", "recommendation", "bundle", "redirect")
VARIANTS = ("A", "B", "control")
KEYS = ("eventType", "surface", "sessionId", "query", "resultCount", "productGid", "position", "experimentId", "variant", "properties", "ts")
MAX_BATCH, MAX_RESULTS, MAX_POSITION, MAX_PROPERTIES = 20, 100_000_000, 100_000, 2000
_SESSION = r"^[A-Za-z0-9_-]{1,64}$"
_PRODUCT = r"^gid://[a-z]+/Product/[0-9]{1,20}$"
_UUID = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def read_events(raw: DataFrame, column: str = "json") -> DataFrame:
    """JSON events as columns, with all keys that an event has (``keys``); what is no object has none of them."""
    text = lambda key: F.get_json_object(column, f"$.{key}")
    names = {"event_type": "eventType", "surface": "surface", "session_id": "sessionId", "query": "query", "result_count": "resultCount", "product_gid": "productGid", "position": "position", "experiment_id": "experimentId", "variant": "variant"}
    return raw.select("*", *[text(key).alias(name) for name, key in names.items()], text("properties").alias("properties"), F.json_object_keys(column).alias("keys"))


def _bounded(c: str, most: int) -> Column:
    """The whole part of a number within 0..most; null otherwise."""
    n = F.floor(F.col(c).cast("string").try_cast("double"))
    return F.when(n.between(0, most), n.cast("int"))


def event_valid(columns: list[str], session_allowed: bool = True) -> Column:
    """Allow-list of one event; an absent or empty value is fine, a malformed one is not, nor is an unknown key."""
    ok = F.coalesce(F.col("event_type").isin(*EVENT_TYPES) & F.col("surface").isin(*SURFACES), F.lit(False))
    absent = lambda c: F.coalesce(F.col(c).cast("string") == "", F.lit(True))
    optional = lambda c, test: absent(c) | F.coalesce(test, F.lit(False)) if c in columns else F.lit(True)
    if session_allowed:
        ok = ok & optional("session_id", F.col("session_id").rlike(_SESSION))
    ok = ok & optional("product_gid", F.col("product_gid").rlike(_PRODUCT)) & optional("experiment_id", F.col("experiment_id").rlike(_UUID)) & optional("variant", F.col("variant").isin(*VARIANTS))
    for c, most in (("result_count", MAX_RESULTS), ("position", MAX_POSITION)):
        ok = ok & optional(c, _bounded(c, most).isNotNull())
    if "keys" in columns:
        ok = ok & F.coalesce(F.forall("keys", lambda k: k.isin(*KEYS)), F.lit(False))
    return ok


def validate_events(raw: DataFrame, session_allowed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected); works on streams as it is. Without sessions allowed, their ids are neither checked nor kept.

    Clean events have query_norm and query_redacted in place of the query as it was typed, and sanitized properties."""
    valid = event_valid(raw.columns, session_allowed)
    empty_is_null = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    numbers = {"result_count": MAX_RESULTS, "position": MAX_POSITION}
    own = {c: _bounded(c, most).alias(c) for c, most in numbers.items()}
    own |= {c: empty_is_null(c) for c in ("product_gid", "experiment_id", "variant")}
    own |= {"session_id": empty_is_null("session_id") if session_allowed else F.lit(None).cast("string").alias("session_id")}
    if "properties" in raw.columns:
        own["properties"] = sanitize_properties(F.col("properties")).alias("properties")
    clean = raw.where(valid).select(*[own.get(c, F.col(c)) for c in raw.columns if c != "keys"])
    if "query" in raw.columns:
        clean = clean.withColumn("query_norm", clean_query(F.col("query"))).drop("query")
        clean = clean.withColumn("query_redacted", F.coalesce(F.contains("query_norm", F.lit(MARK)), F.lit(False)))
    return clean, raw.where(~valid)


def validate_batches(df: DataFrame, most: int = MAX_BATCH) -> DataFrame:
    """batch_id, kept, rejected: the first events of a batch count if valid, the others are rejected."""
    w = Window.partitionBy("batch_id").orderBy("seq")
    v = df.withColumn("_r", F.row_number().over(w)).withColumn("_ok", event_valid(df.columns) & (F.col("_r") <= most))
    return v.groupBy("batch_id").agg(F.count_if("_ok").alias("kept"), F.count_if(~F.col("_ok")).alias("rejected"))


def sanitize_properties(c: Column) -> Column:
    """JSON text -> JSON text of the scalars of an object: the first 12 with plain keys, strings redacted and cut at 120, numbers
    and booleans as they are; leading entries go until the text has 2000 characters.  What is no object gives {}; null stays null."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    parsed = F.try_parse_json(c)
    members = F.when(F.startswith(kind(parsed), F.lit("OBJECT")), parsed).try_cast("map<string,variant>")
    keys = F.filter(F.array_distinct(F.json_object_keys(c)), lambda k: k.rlike(r"^[A-Za-z0-9_]{1,40}$"))
    entries = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(members, k).alias("value"), kind(F.element_at(members, k)).alias("kind")))
    scalars = F.slice(F.filter(entries, lambda x: x["kind"].rlike("^(STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL)")), 1, 12)
    texts = redact_each(F.transform(scalars, lambda x: F.when(x["kind"] == "STRING", F.try_variant_get(x["value"], "$", "string"))))
    clean = F.zip_with(scalars, texts, lambda x, t: F.struct(x["key"].alias("key"), F.when(x["kind"] == "STRING", F.substring(t, 1, 120).cast("variant")).otherwise(x["value"]).alias("value")))
    as_json = lambda e: F.to_json(F.map_from_entries(e))
    shorter = lambda acc, _: F.when(F.length(as_json(acc)) > MAX_PROPERTIES, F.slice(acc, 2, 12)).otherwise(acc)
    return F.when(c.isNotNull(), F.coalesce(as_json(F.aggregate(F.sequence(F.lit(1), F.lit(12)), clean, shorter)), F.lit("{}")))


def ingest_events(clean: DataFrame, settings: DataFrame) -> DataFrame:
    """Validated events by the tenant's mode: off drops them, anonymous drops the session; with the month that partitions the store."""
    j = clean.join(settings, "tenant_id").where("mode in ('anonymous', 'consented_sessions')")
    return j.withColumn("session_id", F.when(F.col("mode") == "consented_sessions", F.col("session_id"))).withColumn("event_month", F.date_format("occurred_at", "yyyy_MM")).drop("mode")


def map_customer_events(df: DataFrame) -> DataFrame:
    """name, data (JSON) -> event_type, query, product_gid of the two kinds that are kept."""
    kind = F.when(F.col("name") == "search_submitted", "search_performed").when(F.col("name") == "product_added_to_cart", "add_to_cart_from_search")
    gid = F.get_json_object("data", "$.product.id")
    out = df.select("*", kind.alias("event_type"), F.get_json_object("data", "$.query").alias("query"), F.when(gid.rlike(_PRODUCT), gid).alias("product_gid"))
    return out.where("event_type is not null")


def write_month_partitions(events: DataFrame, path: str) -> None:
    events.write.mode("append").partitionBy("event_month").parquet(path)


def write_safe_csv(df: DataFrame, path: str, max_rows: int = 50_000, order: list | None = None) -> None:
    """RFC 4180: cells that spreadsheets cannot run, quoted where needed, lines that end with CRLF, and a header in each file.

    At most ``max_rows`` rows, the first in ``order`` (all columns, if not given)."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    cells = [safe_cell(F.col(c)) if c in text else F.col(c).cast("string") for c in df.columns]
    quoted = [F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit(""))) for c in cells]
    lines = df.orderBy(*(order or df.columns)).limit(max_rows).select(F.concat_ws(",", *quoted).alias("value"))
    header = df.sparkSession.createDataFrame([(",".join(df.columns),)], "value string")
    header.unionByName(lines).coalesce(1).write.option("lineSep", "\r\n").text(path)  # max_rows bounds the one file


# ---- bulk catalog files: one JSON object for each line, children carry __parentId

BULK = "id string, __parentId string, handle string, title string, description string, vendor string, productType string, status string, tags array<string>, onlineStoreUrl string, sku string, barcode string, price string, compareAtPrice string, position int, availableForSale boolean, updatedAt timestamp, metafields struct<nodes: array<struct<namespace: string, key: string, value: string>>>"


def read_bulk(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BULK).json(path).where("id is not null").withColumn("type", gid_type(F.col("id")))


def flatten_metafields(nodes: Column, namespace: str = "custom") -> Column:
    """Scalar values of one namespace as a map of namespace.key."""
    keep = F.filter(nodes, lambda m: (m["namespace"] == namespace) & m["value"].isNotNull() & ~m["value"].rlike(r"^\s*[\[{]"))
    return F.map_from_entries(F.transform(F.coalesce(keep, F.array().cast("array<struct<namespace:string,key:string,value:string>>")), lambda m: F.struct(F.concat_ws(".", m["namespace"], m["key"]).alias("key"), m["value"].alias("value"))))


def read_bulk_products(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(products, variants, memberships); children without their parent in the file are dropped."""
    b = read_bulk(spark, path)
    p = b.where("type = 'Product' and __parentId is null")
    own = p.select(F.col("id").alias("__parentId"))
    products = p.select(F.col("id").alias("gid"), "handle", "title", "description", "vendor", F.col("productType").alias("product_type"), "status", "tags", F.col("onlineStoreUrl").alias("online_store_url"), flatten_metafields(F.col("metafields.nodes")).alias("metafields"), F.col("updatedAt").alias("source_updated_at"))
    child = lambda kind: b.where(F.col("type") == kind).join(own, "__parentId", "left_semi")
    variants = child("ProductVariant").select(F.col("id").alias("variant_gid"), F.col("__parentId").alias("product_gid"), "sku", "barcode", "title", F.col("price").try_cast("decimal(12,2)").alias("price"), F.col("compareAtPrice").try_cast("decimal(12,2)").alias("compare_at_price"), "position", F.col("availableForSale").alias("available_for_sale"))
    return products, variants, child("Collection").select(F.col("__parentId").alias("product_gid"), F.col("id").alias("collection_gid"))


def read_bulk_collections(spark: SparkSession, path: str) -> DataFrame:
    return read_bulk(spark, path).where("type = 'Collection' and __parentId is null").select(F.col("id").alias("collection_gid"), "handle", "title", F.col("updatedAt").alias("source_updated_at"))


def count_bulk_products(bulk: DataFrame, reported: int | None = None) -> int:
    """Products of a bulk file; raises ValueError when none arrive although the source reported objects."""
    n = bulk.agg(F.count_if((F.col("type") == "Product") & F.col("__parentId").isNull())).first()[0]
    if not n and reported:
        raise ValueError(f"the bulk file holds no product, the source reported {reported} objects")
    return n
