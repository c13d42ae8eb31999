"""Bundles: slot resolution, visibility, exact totals, discounts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merchandising import schedule_active

MONEY = "decimal(18,4)"


def validate_bundles(bundles: DataFrame, slots: DataFrame) -> DataFrame:
    """2..10 slots with quantities 1..10 and distinct references, fixed slots with a variant, a fitting mix count, start before end."""
    s = slots.groupBy("bundle_id").agg(
        F.count("*").alias("n"), F.bool_and(F.col("quantity").between(1, 10)).alias("q"), F.count_distinct("ref_kind", "ref_value").alias("d"), F.bool_and((F.col("variant_mode") != "fixed") | F.col("variant_gid").isNotNull()).alias("f")
    )
    j = bundles.join(s, "bundle_id", "left")
    ok = F.col("n").between(2, 10) & F.col("q") & (F.col("d") == F.col("n")) & F.col("f") & ((F.col("bundle_type") != "mix") | F.col("mix_count").between(1, F.col("n"))) & F.coalesce(F.col("starts_at") < F.col("ends_at"), F.lit(True))
    return j.select("bundle_id", F.coalesce(ok, F.lit(False)).alias("valid"))


def resolve_products(slots: DataFrame, docs: DataFrame) -> DataFrame:
    """Slots with the visible product that their gid or handle names; product_id null where none."""
    g = docs.select(F.lit("gid").alias("ref_kind"), F.col("gid").alias("k"), "product_id").unionByName(docs.select(F.lit("handle").alias("ref_kind"), F.lower("handle").alias("k"), "product_id"))
    k = F.when(F.col("ref_kind") == "handle", F.lower("ref_value")).otherwise(F.col("ref_value"))
    return slots.withColumn("k", k).join(g, ["ref_kind", "k"], "left").drop("k")


def duplicate_slots(slots: DataFrame, docs: DataFrame) -> DataFrame:
    """Slots of a bundle that lead to the same product."""
    r = resolve_products(slots, docs).where("product_id is not null")
    w = Window.partitionBy("bundle_id", "product_id")
    return r.withColumn("_n", F.count("*").over(w)).where("_n > 1").select("bundle_id", "slot", "product_id")


def resolve_slots(slots: DataFrame, docs: DataFrame, variants: DataFrame) -> DataFrame:
    """bundle_id, slot, product_id, variant_gid, price, quantity, reason (null: purchasable).

    A fixed slot takes its variant, others the first purchasable by position (nulls last), then id: settled once for each
    product and for each variant, so slots meet one row.  The result is partitioned by bundle."""
    own = ~F.coalesce(F.col("variant_mode") != "fixed", F.lit(False))
    r = resolve_products(slots, docs).withColumns({"_own": own, "_gid": F.when(own, F.col("variant_gid")).otherwise("")})
    ok = variants.where("deleted_at is null and available_for_sale").select("product_id", F.col("variant_gid").alias("v_gid"), F.col("price").cast(MONEY).alias("price"), "position").where("price is not null")
    choice = F.explode(F.array(F.struct(F.lit(False).alias("own"), F.lit("").alias("gid")), F.struct(F.lit(True).alias("own"), F.col("v_gid").alias("gid"))))
    v = ok.withColumn("c", choice).groupBy("product_id", F.col("c.own").alias("_own"), F.col("c.gid").alias("_gid")).agg(F.min(F.struct(F.col("position").isNull(), "position", "v_gid", "price")).alias("b"))
    out = r.join(v, ["product_id", "_own", "_gid"], "left").repartition("bundle_id").withColumn("b", F.min("b").over(Window.partitionBy("bundle_id", "slot")))
    reason = F.when(F.col("product_id").isNull(), "not_in_catalog").when(F.col("b").isNull(), F.when(F.col("variant_mode") == "fixed", "variant_unavailable").otherwise("out_of_stock"))
    return out.select("bundle_id", "slot", "product_id", F.col("b.v_gid").alias("variant_gid"), F.col("b.price").alias("price"), "quantity", reason.alias("reason"))


def bundle_visibility(bundles: DataFrame, resolved: DataFrame, now: datetime) -> DataFrame:
    """Active, scheduled, and purchasable: all slots of a fixed bundle, enough distinct products of a mix."""
    s = resolved.groupBy("bundle_id").agg(F.count_if(F.col("reason").isNotNull()).alias("blocked"), F.count_distinct(F.when(F.col("reason").isNull(), F.col("product_id"))).alias("ok"))
    j = bundles.join(s, "bundle_id", "left")
    enough = F.when(F.col("bundle_type") == "mix", F.col("ok") >= F.col("mix_count")).otherwise(F.col("blocked") == 0)
    return j.select("bundle_id", F.coalesce((F.col("status") == "active") & schedule_active(now) & enough, F.lit(False)).alias("visible"))


def bundle_totals(bundles: DataFrame, resolved: DataFrame) -> DataFrame:
    """Exact totals: the sum of a fixed bundle; of a mix the n cheapest and the n dearest lines."""
    line = (F.col("price") * F.col("quantity")).cast(MONEY)
    r = resolved.where("reason is null").withColumn("line", line).join(bundles.select("bundle_id", "bundle_type", "mix_count"), "bundle_id")
    w = Window.partitionBy("bundle_id")
    r = r.withColumn("lo", F.row_number().over(w.orderBy("line", "slot"))).withColumn("hi", F.row_number().over(w.orderBy(F.desc("line"), "slot")))
    take = lambda rank: F.sum(F.when((F.col("bundle_type") != "mix") | (F.col(rank) <= F.col("mix_count")), F.col("line"))).cast(MONEY)
    return r.groupBy("bundle_id").agg(take("lo").alias("total_min"), take("hi").alias("total_max"))


def bundles_for_products(refs: DataFrame, bundles: DataFrame, slots: DataFrame, docs: DataFrame, limit: int = 20) -> DataFrame:
    """The bundles that hold a product: position, newest, id."""
    s = resolve_products(slots, docs).select("bundle_id", "product_id").distinct()
    j = refs.join(s, "product_id").join(bundles, "bundle_id")
    w = Window.partitionBy("product_id").orderBy("position", F.desc("created_at"), "bundle_id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("product_id", "bundle_id", "rank")


def bundle_discount(subtotal: Column, kind: Column, value: Column) -> Column:
    """Discount in minor units: percent (half-up), fixed_amount or fixed_price; within 0..subtotal."""
    raw = F.when(kind == "percent", F.round((subtotal.cast("decimal(18,0)") * value) / 100, 0)).when(kind == "fixed_amount", value).when(kind == "fixed_price", subtotal - value)
    return F.greatest(F.least(F.coalesce(raw, F.lit(0)), subtotal), F.lit(0)).cast("long")


def bundle_signal_summary(signals: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    return signals.where((F.col("day") > F.lit((now - timedelta(days=days)).date())) & (F.col("day") <= F.lit(now.date()))).groupBy("bundle_id").agg(F.sum("views").alias("views"), F.sum("clicks").alias("clicks"))
