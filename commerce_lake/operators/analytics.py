"""Event reports, rollups, attribution, experiments, retention."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The event types that count as clicks.
CLICKS = ("result_click", "predictive_click", "suggestion_click", "recommendation_click")
SEARCH, ZERO, CART, REDIRECT = "search_performed", "search_zero_result", "add_to_cart_from_search", "redirect_followed"


def _of(*types: str) -> Column:
    return F.count_if(F.col("event_type").isin(*types))


def resolve_window(start: str | None, end: str | None, now: datetime, retention_days: int) -> tuple[datetime, datetime]:
    """The report window: the last 30 days unless both bounds are well formed; kept inside retention and now."""
    default = (now - timedelta(days=29), now)
    try:
        lo = datetime.fromisoformat(start) if start else default[0]
        hi = datetime.fromisoformat(end) if end else default[1]
    except ValueError:
        lo, hi = default
    floor = now - timedelta(days=retention_days)
    lo, hi = max(min(lo, now), floor), max(min(hi, now), floor)
    return (hi - timedelta(days=1), hi) if lo > hi else (lo, hi)


def in_window(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Half-open window; also on the month partition where the table has one, so that it prunes."""
    out = events.where((F.col("occurred_at") >= F.lit(start)) & (F.col("occurred_at") < F.lit(end)))
    if "event_month" in events.columns:
        out = out.where(F.col("event_month").between(start.strftime("%Y_%m"), end.strftime("%Y_%m")))
    return out


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 9)).otherwise(F.lit(0.0))


def summary_report(events: DataFrame) -> DataFrame:
    t = events.groupBy("tenant_id").agg(_of(SEARCH).alias("searches"), _of(ZERO).alias("zero_results"), _of(*CLICKS).alias("clicks"), _of(CART).alias("add_to_carts"), _of(REDIRECT).alias("redirects"))
    return t.select("*", _ratio("clicks", "searches").alias("ctr"), _ratio("zero_results", "searches").alias("zero_rate"), _ratio("add_to_carts", "searches").alias("cart_rate"))


def query_report(events: DataFrame) -> DataFrame:
    return events.where("query_norm is not null").groupBy("tenant_id", "query_norm").agg(_of(SEARCH).alias("searches"), _of(*CLICKS).alias("clicks"), _of(ZERO).alias("zero_results"))


def _top(df: DataFrame, k: int, by: str) -> DataFrame:
    w = Window.partitionBy("tenant_id").orderBy(F.desc(by), "query_norm")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_queries(events: DataFrame, k: int = 200) -> DataFrame:
    return _top(query_report(events).where("searches > 0"), k, "searches")


def zero_result_queries(events: DataFrame, k: int = 200) -> DataFrame:
    return _top(query_report(events).where("zero_results > 0").select("tenant_id", "query_norm", "zero_results"), k, "zero_results")


def no_click_queries(events: DataFrame, k: int = 200) -> DataFrame:
    return _top(query_report(events).where("searches > 0 and clicks = 0").select("tenant_id", "query_norm", "searches"), k, "searches")


def per_surface(events: DataFrame) -> DataFrame:
    return events.groupBy("tenant_id", "surface").agg(F.count("*").alias("n"))


def daily_trend(events: DataFrame) -> DataFrame:
    return events.groupBy("tenant_id", F.to_date("occurred_at").alias("day")).agg(_of(SEARCH).alias("searches"), _of(*CLICKS).alias("clicks"), _of(ZERO).alias("zero_results"), _of(CART).alias("add_to_carts"))


def rollup_days(now: datetime, last_rolled: date | None, refresh: int = 2, backfill: int = 14, retention: int = 400) -> tuple[date, date]:
    """First and last completed day to roll: the most recent ones again, and up to ``backfill`` further back."""
    last = now.date() - timedelta(days=1)
    first = last - timedelta(days=refresh - 1)
    if last_rolled is None or last_rolled < first:
        first = min(first, max((last_rolled or date.min) + timedelta(days=1) if last_rolled else first - timedelta(days=backfill), first - timedelta(days=backfill)))
    return max(first, now.date() - timedelta(days=retention)), last


def rollup_daily(events: DataFrame, first: date, last: date) -> DataFrame:
    """Counts of completed days; write with dynamic partition overwrite by day."""
    day = F.to_date("occurred_at")
    return events.where(day.between(F.lit(first), F.lit(last))).groupBy("tenant_id", day.alias("day"), "event_type", "surface").agg(F.count("*").alias("n"))


def hybrid_summary(rollup: DataFrame, events: DataFrame, today: date) -> DataFrame:
    """The summary from the rollup of completed days and the raw events of today; equals summary_report over both."""
    raw = events.where(F.to_date("occurred_at") >= F.lit(today)).groupBy("tenant_id", "event_type").agg(F.count("*").alias("n"))
    both = rollup.select("tenant_id", "event_type", "n").unionByName(raw)
    of = lambda *types: F.coalesce(F.sum(F.when(F.col("event_type").isin(*types), F.col("n"))), F.lit(0))
    t = both.groupBy("tenant_id").agg(of(SEARCH).alias("searches"), of(ZERO).alias("zero_results"), of(*CLICKS).alias("clicks"), of(CART).alias("add_to_carts"), of(REDIRECT).alias("redirects"))
    return t.select("*", _ratio("clicks", "searches").alias("ctr"), _ratio("zero_results", "searches").alias("zero_rate"), _ratio("add_to_carts", "searches").alias("cart_rate"))


def rollup_coverage(rollup: DataFrame, first: date, last: date, least_days: int = 45) -> DataFrame:
    """Whether a window is long enough and enclosed by the rolled days."""
    span = (last - first).days + 1
    return rollup.groupBy("tenant_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")).withColumn("covered", (F.col("first_day") <= F.lit(first)) & (F.col("last_day") >= F.lit(last)) & F.lit(span > least_days))


def write_rollup(events: DataFrame, path: str, first: date, last: date) -> None:
    """Puts the counts of the days first to last in place of those stored under ``path``; a second run changes nothing.

    Each day is a partition and is overwritten alone. A day has a row without an event type besides its counts, so that a
    day whose events are gone is overwritten too."""
    spark = events.sparkSession
    days = spark.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    tenant = events.schema["tenant_id"].dataType
    marks = days.select(F.lit(None).cast(tenant).alias("tenant_id"), "day", F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("string").alias("surface"), F.lit(0).cast("long").alias("n"))
    counts = rollup_daily(events, first, last).select(marks.columns)
    counts.unionByName(marks).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_rollup(spark: SparkSession, path: str, tenant_type: str = "string") -> DataFrame:
    """The stored counts: tenant_id, event_type, surface, n, day."""
    return spark.read.schema(f"tenant_id {tenant_type}, event_type string, surface string, n long, day date").parquet(path).where("event_type is not null")


def windowed_summary(rollup: DataFrame, events: DataFrame, first: date, last: date, today: date, least_days: int = 45) -> DataFrame:
    """summary_report of the events of the days first to last, from the rollup where it serves.

    A tenant whose rolled days enclose the window's completed days, more than least_days of them, is read from the rollup and
    today's raw events; every other tenant from raw events alone. Both equal the raw report."""
    done = min(last, today - timedelta(days=1))
    day = F.to_date("occurred_at")
    raw = events.where(day.between(F.lit(first), F.lit(last)))
    covered = rollup_coverage(rollup, first, done, least_days).where("covered").select("tenant_id")
    rolled = rollup.where(F.col("day").between(F.lit(first), F.lit(done))).join(covered, "tenant_id", "left_semi")
    now = raw.where(day > F.lit(done)).join(covered, "tenant_id", "left_semi")
    rest = raw.join(covered, "tenant_id", "left_anti")
    return hybrid_summary(rolled, now.unionByName(rest), first)


def attribute_carts(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Each add-to-cart with the last click on its product before it in its session, within the look-back.

    One exchange on (tenant, session, product).  At one time, event types sort by name, so
    a click in the same instant comes after the cart event and is not attributed."""
    w = Window.partitionBy("tenant_id", "session_id", "product_id").orderBy("occurred_at", "event_type", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    click = F.when(F.col("event_type").isin(*CLICKS), F.struct("occurred_at", "event_id", "surface"))
    carts = events.where(F.col("event_type").isin(*CLICKS, CART) & F.col("product_id").isNotNull()).where("session_id is not null").withColumn("click", F.last(click, ignorenulls=True).over(w)).where(F.col("event_type") == CART)
    inside = F.col("click.occurred_at") >= F.col("occurred_at") - F.make_dt_interval(mins=F.lit(minutes))
    return carts.select("tenant_id", "event_id", "session_id", "product_id", F.when(inside, F.col("click.event_id")).alias("click_id"), F.when(inside, F.col("click.surface")).alias("click_surface"))


def variant_stats(events: DataFrame) -> DataFrame:
    t = events.where("variant is not null").groupBy("tenant_id", "variant").agg(_of(SEARCH).alias("searches"), _of(*CLICKS).alias("clicks"), _of(CART).alias("add_to_carts"))
    return t.select("*", _ratio("clicks", "searches").alias("ctr"), _ratio("add_to_carts", "searches").alias("cart_rate"))


def compare_arms(stats: DataFrame, least_trials: int = 100, least_successes: int = 10, z_limit: float = 1.96) -> DataFrame:
    """Pooled two-proportion z test of clicks over searches between arms A and B."""
    side = lambda arm: stats.where(F.col("variant") == arm).select("tenant_id", F.col("searches").alias(f"n_{arm}"), F.col("clicks").alias(f"x_{arm}"))
    t = side("A").join(side("B"), "tenant_id")
    pooled = (F.col("x_A") + F.col("x_B")) / (F.col("n_A") + F.col("n_B"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n_A") + 1 / F.col("n_B")))
    enough = (F.least("n_A", "n_B") >= least_trials) & (F.least("x_A", "x_B") >= least_successes)
    z = F.when(enough & (spread > 0), F.round((F.col("x_B") / F.col("n_B") - F.col("x_A") / F.col("n_A")) / spread, 9))
    return t.select("tenant_id", z.alias("z"), F.when(z.isNull(), "inconclusive").when(F.abs(z) >= z_limit, "significant").otherwise("not_significant").alias("verdict"))


def purge_older_than(df: DataFrame, column: str, now: datetime, days: int) -> DataFrame:
    """Rows at or after the cutoff."""
    return df.where(F.col(column) >= F.lit(now - timedelta(days=days)))


def month_of(c: Column) -> Column:
    return F.date_format(c, "yyyy_MM")


def month_targets(now: datetime, offsets: tuple[int, ...] = (0, 1, 2)) -> list[str]:
    return [f"{now.year + (now.month - 1 + o) // 12}_{(now.month - 1 + o) % 12 + 1:02d}" for o in offsets]


def drop_months_before(df: DataFrame, cutoff: datetime, now: datetime, floor_days: int = 395) -> DataFrame:
    """Keeps months from the cutoff's on; the cutoff is never newer than the floor."""
    limit = min(cutoff, now - timedelta(days=floor_days))
    return df.where(F.col("event_month") >= limit.strftime("%Y_%m"))


def erase(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without the given keys, and how many each key held."""
    held = df.join(keys.select(*on).distinct(), on, "left_semi").groupBy(*on).agg(F.count("*").alias("held"))
    return df.join(keys.select(*on).distinct(), on, "left_anti"), held


def export_events(events: DataFrame, cap: int = 50_000) -> DataFrame:
    """The newest rows for a spreadsheet."""
    return events.select("event_id", "event_type", "occurred_at", "surface", "query_norm", "product_id", "session_id", "variant").orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(cap)
