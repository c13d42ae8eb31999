"""Event analytics over the driver's ``events`` table."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..sources import bridge as B
from ..sources.store import shared_root
from .registry import query

NOW = datetime(2024, 1, 31)
START = datetime(2024, 1, 2)
_E = B.sql("event")
_W = "occurred_at >= TIMESTAMP '2024-01-02' AND occurred_at < TIMESTAMP '2024-01-31'"
_CL = "('result_click','predictive_click','suggestion_click','recommendation_click')"
_SUM = f"""count(*) FILTER (WHERE event_type = 'search_performed') AS searches, count(*) FILTER (WHERE event_type = 'search_zero_result') AS zero_results,
 count(*) FILTER (WHERE event_type IN {_CL}) AS clicks, count(*) FILTER (WHERE event_type = 'add_to_cart_from_search') AS add_to_carts, count(*) FILTER (WHERE event_type = 'redirect_followed') AS redirects"""
_RATES = """CASE WHEN searches > 0 THEN round(clicks / searches, 9) ELSE 0 END AS ctr, CASE WHEN searches > 0 THEN round(zero_results / searches, 9) ELSE 0 END AS zero_rate, CASE WHEN searches > 0 THEN round(add_to_carts / searches, 9) ELSE 0 END AS cart_rate"""


def _events(spark, sf_dir):
    return A.in_window(B.events(spark, sf_dir), START, NOW)


@query(f"{_E}, s AS (SELECT {_SUM} FROM event WHERE {_W}) SELECT *, {_RATES} FROM s")
def summary_report(spark, sf_dir):
    return A.summary_report(_events(spark, sf_dir)).drop("tenant_id")


_Q = f"{_E}, q AS (SELECT query_norm, {_SUM} FROM event WHERE {_W} AND query_norm IS NOT NULL GROUP BY 1)"


@query(f"{_Q} SELECT * FROM (SELECT query_norm, searches, clicks, zero_results, row_number() OVER (ORDER BY searches DESC, query_norm)::INTEGER AS rank FROM q WHERE searches > 0) WHERE rank <= 200")
def top_queries(spark, sf_dir):
    return A.top_queries(_events(spark, sf_dir)).drop("tenant_id")


@query(f"{_Q} SELECT * FROM (SELECT query_norm, zero_results, row_number() OVER (ORDER BY zero_results DESC, query_norm)::INTEGER AS rank FROM q WHERE zero_results > 0) WHERE rank <= 200")
def zero_result_queries(spark, sf_dir):
    return A.zero_result_queries(_events(spark, sf_dir)).drop("tenant_id")


@query(f"{_Q} SELECT * FROM (SELECT query_norm, searches, row_number() OVER (ORDER BY searches DESC, query_norm)::INTEGER AS rank FROM q WHERE searches > 0 AND clicks = 0) WHERE rank <= 200")
def no_click_queries(spark, sf_dir):
    return A.no_click_queries(_events(spark, sf_dir)).drop("tenant_id")


@query(f"{_E} SELECT surface, count(*) AS n FROM event WHERE {_W} GROUP BY 1")
def per_surface(spark, sf_dir):
    return A.per_surface(_events(spark, sf_dir)).drop("tenant_id")


@query(f"{_E} SELECT occurred_at::DATE AS day, {_SUM.rsplit(', count', 1)[0]} FROM event WHERE {_W} GROUP BY 1")
def daily_trend(spark, sf_dir):
    return A.daily_trend(_events(spark, sf_dir)).drop("tenant_id")


@query(f"{_E} SELECT occurred_at::DATE AS day, event_type, surface, count(*) AS n FROM event WHERE occurred_at::DATE BETWEEN DATE '2024-01-16' AND DATE '2024-01-29' GROUP BY ALL")
def rollup_daily(spark, sf_dir):
    first, last = A.rollup_days(datetime(2024, 1, 30), date(2024, 1, 15))
    return A.rollup_daily(B.events(spark, sf_dir), first, last).drop("tenant_id")


@query(f"{_E}, s AS (SELECT {_SUM} FROM event) SELECT *, {_RATES} FROM s")
def hybrid_summary(spark, sf_dir):
    e, today = B.events(spark, sf_dir), date(2024, 1, 29)
    return A.hybrid_summary(A.rollup_daily(e, date(2023, 1, 1), date(2024, 1, 28)), e, today).drop("tenant_id")


@query(f"""{_E}, w AS (SELECT * FROM (VALUES ('rolled', DATE '2024-01-03', DATE '2024-01-29'), ('raw', DATE '2024-01-20', DATE '2024-01-29')) AS w(source, first, last)),
s AS (SELECT source, {_SUM} FROM event JOIN w ON occurred_at::DATE BETWEEN first AND last GROUP BY source) SELECT *, {_RATES} FROM s""")
def windowed_summary(spark, sf_dir):
    """Summaries of a long window, from the written rollup and today's events, and of a short one, from the events."""
    e, path = B.events(spark, sf_dir), f"{shared_root(spark)}/rollup-{uuid.uuid4().hex}"
    A.write_rollup(e, path, date(2024, 1, 1), date(2024, 1, 20))
    A.write_rollup(e, path, date(2024, 1, 18), date(2024, 1, 28))
    rollup = A.read_rollup(spark, path, e.schema["tenant_id"].dataType.simpleString())
    of = lambda name, first: A.windowed_summary(rollup, e, first, date(2024, 1, 29), date(2024, 1, 29), 20).drop("tenant_id").withColumn("source", F.lit(name))
    return of("rolled", date(2024, 1, 3)).unionByName(of("raw", date(2024, 1, 20)))


@query(f"{_E}, d AS (SELECT min(occurred_at::DATE) AS first_day, max(occurred_at::DATE) AS last_day FROM event) SELECT first_day, last_day, first_day <= DATE '2024-01-05' AND last_day >= DATE '2024-01-25' AND 21 > 45 AS covered FROM d")
def rollup_coverage(spark, sf_dir):
    r = A.rollup_daily(B.events(spark, sf_dir), date(2023, 1, 1), date(2024, 1, 31))
    return A.rollup_coverage(r, date(2024, 1, 5), date(2024, 1, 25)).drop("tenant_id")


@query(f"""{_E}, c AS (SELECT * FROM event WHERE product_id IS NOT NULL AND event_type IN {_CL}), a AS (SELECT * FROM event WHERE product_id IS NOT NULL AND event_type = 'add_to_cart_from_search'),
j AS (SELECT a.event_id, a.session_id, a.product_id, c.event_id AS click_id, c.surface AS click_surface, row_number() OVER (PARTITION BY a.event_id ORDER BY c.occurred_at DESC, c.event_type DESC, c.event_id DESC) AS r
 FROM a LEFT JOIN c ON a.session_id = c.session_id AND a.product_id = c.product_id AND (c.occurred_at, c.event_type) < (a.occurred_at, a.event_type) AND c.occurred_at >= a.occurred_at - INTERVAL 30 MINUTE)
SELECT event_id, session_id, product_id, click_id, click_surface FROM j WHERE r = 1""")
def attribute_carts(spark, sf_dir):
    return A.attribute_carts(B.events(spark, sf_dir)).drop("tenant_id")


_V = f"{_E}, v AS (SELECT variant, count(*) FILTER (WHERE event_type = 'search_performed') AS searches, count(*) FILTER (WHERE event_type IN {_CL}) AS clicks, count(*) FILTER (WHERE event_type = 'add_to_cart_from_search') AS add_to_carts FROM event WHERE variant IS NOT NULL GROUP BY 1)"


@query(f"{_V} SELECT *, round(clicks / searches, 9) AS ctr, round(add_to_carts / searches, 9) AS cart_rate FROM v")
def variant_stats(spark, sf_dir):
    return A.variant_stats(B.events(spark, sf_dir)).drop("tenant_id")


@query(f"""{_V}, p AS (SELECT a.searches AS n1, a.clicks AS x1, b.searches AS n2, b.clicks AS x2, (a.clicks + b.clicks) / (a.searches + b.searches) AS q FROM v a, v b WHERE a.variant = 'A' AND b.variant = 'B'),
z AS (SELECT CASE WHEN least(n1, n2) >= 100 AND least(x1, x2) >= 10 THEN round((x2 / n2 - x1 / n1) / sqrt(q * (1 - q) * (1 / n1 + 1 / n2)), 9) END AS z FROM p)
SELECT z, CASE WHEN z IS NULL THEN 'inconclusive' WHEN abs(z) >= 1.96 THEN 'significant' ELSE 'not_significant' END AS verdict FROM z""")
def compare_arms(spark, sf_dir):
    return A.compare_arms(A.variant_stats(B.events(spark, sf_dir))).drop("tenant_id")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-11'")
def purge_older_than(spark, sf_dir):
    return A.purge_older_than(B.table(spark, sf_dir, "events"), "ts", NOW, 20).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT strftime(o_orderdate, '%Y_%m') AS event_month, count(*) AS n FROM orders WHERE strftime(o_orderdate, '%Y_%m') >= '1998_06' GROUP BY 1")
def drop_months_before(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").withColumn("event_month", A.month_of(F.col("o_orderdate")))
    return A.drop_months_before(o, datetime(1998, 6, 15), NOW).groupBy("event_month").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS held FROM events WHERE user_id % 10 = 3 GROUP BY 1")
def erase_held(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    return A.erase(e, e.where("user_id % 10 = 3").select("user_id"), ["user_id"])[1]


@query("SELECT event_id, user_id FROM events WHERE user_id % 10 <> 3")
def erase(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    return A.erase(e, e.where("user_id % 10 = 3").select("user_id"), ["user_id"])[0].select("event_id", "user_id")


@query(f"{_E} SELECT event_id, event_type, surface, query_norm, product_id, session_id, variant FROM event WHERE {_W} ORDER BY occurred_at DESC, event_id DESC LIMIT 50000")
def export_events(spark, sf_dir):
    return A.export_events(_events(spark, sf_dir)).drop("occurred_at")
