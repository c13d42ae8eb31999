"""Recommendations, merchandising and experiments over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import trigram_similarity as tsim
from ..operators import merchandising as M
from ..operators import recommend as R
from ..sources import bridge as B
from ..sources.store import stored
from .catalog_queries import DOC_SQL, stored_vis, vis
from .registry import query

NOW = datetime(2024, 1, 31)
_E = B.SQL["event"]
_TG = "list_distinct(flatten(list_transform(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _tg(c):
    return _TG.format(c=c)


def _seeds(spark, sf_dir):
    """Searches ask for every visible product whose number is divisible by 100."""
    return vis(spark, sf_dir).where("cast(product_id as long) % 100 = 0").select(F.col("product_id").alias("seed_id"), F.col("product_id").alias("seed_product"))


#: What similar products are told by.
_ALIKE = ("product_id", "title", "vendor", "product_type", "collections", "tags", "price_min", "available")


def _sim_sql(w):
    return f"""{DOC_SQL}, tr AS (SELECT product_id, p_partkey, title, vendor, product_type, collections, list_distinct(tags) AS tags, price_min::DOUBLE AS price, available, {_tg('title')} AS tg FROM vis),
sd AS (SELECT * FROM tr WHERE p_partkey % 100 = 0), j AS (SELECT s.product_id AS seed_id, t.product_id, t.title, t.vendor, least(len(list_intersect(t.collections, s.collections)), {w['collections'][1]}) * {w['collections'][0]}::DOUBLE AS sc, (t.product_type = s.product_type)::INT * {w['type']}::DOUBLE AS sy, (t.vendor = s.vendor)::INT * {w['vendor']}::DOUBLE AS sv,
 least(len(list_intersect(t.tags, s.tags)), {w['tags'][1]}) * {w['tags'][0]}::DOUBLE AS st, coalesce(greatest(1 - least(abs(s.price - t.price) / greatest(s.price, 1), 1), 0), 0) * {w['price']}::DOUBLE AS sp, (len(list_intersect(t.tg, s.tg)) / (len(t.tg) + len(s.tg) - len(list_intersect(t.tg, s.tg)))) * {w['title']}::DOUBLE AS sl FROM sd s, tr t WHERE s.product_id <> t.product_id),
g AS (SELECT seed_id, product_id, title, vendor, round(sc + sy + sv + st + sp + sl, 9) AS score FROM j WHERE sc + sy + sv + st > 0 OR sl >= 0.3 * {w['title']}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, title, product_id)::INTEGER AS rank FROM g)"""


@query(f"{_sim_sql(R.SIMILAR)} SELECT seed_id, product_id, score, rank FROM ranked WHERE rank <= 24")
def similar(spark, sf_dir):
    return R.similar(_seeds(spark, sf_dir), stored_vis(spark, sf_dir, *_ALIKE)).select("seed_id", "product_id", "score", "rank")


@query(f"{_sim_sql(R.RELATED)} SELECT seed_id, product_id, score, rank FROM ranked WHERE rank <= 24")
def related(spark, sf_dir):
    return R.similar(_seeds(spark, sf_dir), stored_vis(spark, sf_dir, *_ALIKE), weights=R.RELATED).select("seed_id", "product_id", "score", "rank")


@query(f"{_sim_sql(R.SIMILAR)} SELECT seed_id, product_id, vendor, rank FROM (SELECT *, row_number() OVER (PARTITION BY seed_id, vendor ORDER BY rank) AS n FROM ranked WHERE rank <= 24) WHERE vendor IS NULL OR n <= 2")
def diversify(spark, sf_dir):
    return R.diversify(R.similar(_seeds(spark, sf_dir), stored_vis(spark, sf_dir, *_ALIKE)), 2).select("seed_id", "product_id", "vendor", "rank")


@query(f"{_sim_sql(R.SIMILAR)} SELECT s.product_id AS seed_id, t.product_id FROM sd s, tr t WHERE s.product_type = t.product_type OR s.vendor = t.vendor OR list_has_any(s.tags, t.tags) OR list_has_any(s.collections, t.collections) OR len(list_intersect(s.tg, t.tg)) / len(list_distinct(list_concat(s.tg, t.tg))) >= 0.3")
def candidates(spark, sf_dir):
    return R.candidates(_seeds(spark, sf_dir), stored_vis(spark, sf_dir, *_ALIKE))


@query(f"SELECT a.p_partkey AS a, round(coalesce(len(list_intersect({_tg('a.p_name')}, {_tg('b.p_name')})) / len(list_distinct(list_concat({_tg('a.p_name')}, {_tg('b.p_name')}))), 0), 9) AS sim, round(greatest(1 - least(abs(a.p_retailprice - b.p_retailprice) / greatest(a.p_retailprice, 1), 1), 0), 9) AS price FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def trigram_similarity(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    b = p.select((F.col("p_partkey") - 1).alias("a"), F.col("p_name").alias("other"), F.col("p_retailprice").alias("price_b"))
    return p.select(F.col("p_partkey").alias("a"), "p_name", "p_retailprice").join(b, "a").select("a", F.round(tsim(F.col("p_name"), F.col("other")), 9).alias("sim"), F.round(R.price_proximity(F.col("p_retailprice"), F.col("price_b")), 9).alias("price"))


_SIG = f"""{DOC_SQL}, bc AS (SELECT CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'click' END AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id, ts FROM events),
sig AS (SELECT product_id, ts::DATE AS day, count(*) FILTER (WHERE kind = 'view') AS views, count(*) FILTER (WHERE kind = 'click') AS clicks FROM bc JOIN vis ON p_partkey = k WHERE kind IS NOT NULL AND event_id % 5 <> 4 GROUP BY ALL)"""


def _signals(spark, sf_dir, v):
    """Beacons with refs of every kind: gid in odd case, handle, and junk."""
    e = B.table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("long").alias("p_partkey"))
    p = B.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey")).alias("handle"))
    n = F.col("event_id") % 5
    ref = F.when(n < 2, F.concat(F.lit(" GID://store/Product/"), "p_partkey")).when(n < 4, F.upper("handle")).otherwise("no such thing!")
    return R.record_signals(e.join(p, "p_partkey", "left").select(ref.alias("ref"), F.col("event_type").alias("kind"), F.col("ts").alias("occurred_at")), v)


@query(f"{_SIG} SELECT * FROM sig")
def record_signals(spark, sf_dir):
    return _signals(spark, sf_dir, stored_vis(spark, sf_dir))


_TREND = f"{_SIG}, ts AS (SELECT product_id, round(sum((views + 3 * clicks) * pow(0.5, (DATE '2024-01-31' - day) / 7)), 9) AS score FROM sig WHERE DATE '2024-01-31' - day BETWEEN 0 AND 56 GROUP BY 1), tt AS (SELECT product_id, title, score FROM ts JOIN vis USING (product_id) WHERE score > 0 ORDER BY score DESC, title, product_id LIMIT {{k}})"


@query(f"{_TREND.format(k=24)} SELECT * FROM tt")
def trending(spark, sf_dir):
    v = stored_vis(spark, sf_dir)
    return R.trending(_signals(spark, sf_dir, v), v, NOW)


def _dated(spark, sf_dir, v):
    first = B.variants(spark, sf_dir).groupBy("product_id").agg(F.min("created_at").alias("created_at"))
    return v.join(first, "product_id", "left")


@query(f"{_TREND.format(k=5)}, cr AS (SELECT product_id, min(created_at) AS created_at FROM variant GROUP BY 1), nw AS (SELECT product_id, title, created_at FROM vis LEFT JOIN cr USING (product_id) WHERE product_id NOT IN (SELECT product_id FROM tt) ORDER BY created_at DESC NULLS LAST, title, product_id LIMIT 12), al AS (SELECT product_id, title, 0 AS part, score, NULL::TIMESTAMP AS created_at FROM tt UNION ALL SELECT product_id, title, 1, NULL, created_at FROM nw) SELECT product_id, title, part, rank FROM (SELECT *, row_number() OVER (ORDER BY part, score DESC NULLS LAST, created_at DESC NULLS LAST, title, product_id)::INTEGER AS rank FROM al) WHERE rank <= 12")
def newest_top_up(spark, sf_dir):
    v = stored_vis(spark, sf_dir)
    return R.top_up(R.trending(_signals(spark, sf_dir, v), v, NOW, k=5), _dated(spark, sf_dir, v), 12)


_PAIRS = f"{DOC_SQL}, bk AS (SELECT DISTINCT l_orderkey AS b, product_id AS p FROM lineitem JOIN vis ON p_partkey = l_partkey), sb AS (SELECT * FROM bk{{which}}), co AS (SELECT x.p AS a, y.p AS b, count(*) AS n FROM sb x JOIN sb y ON x.b = y.b AND x.p <= y.p GROUP BY ALL)"
_CO = _PAIRS.replace("{which}", " WHERE b IN (SELECT b FROM bk GROUP BY 1 HAVING count(*) <= 50)")


@query(f"{_CO} SELECT * FROM co")
def build_cooccurrence(spark, sf_dir):
    return R.build_cooccurrence(B.baskets(spark, sf_dir), vis(spark, sf_dir))


@query(f"""{_PAIRS.replace('{which}', '')}, sp AS (SELECT a AS p, n AS s FROM co WHERE a = b), nn AS (SELECT count(DISTINCT b) AS baskets FROM sb), dr AS (SELECT a, b, n FROM co WHERE a <> b UNION ALL SELECT b, a, n FROM co WHERE a <> b),
f AS (SELECT dr.a AS seed_product, dr.b AS product_id, n, round(n / s1.s, 9) AS confidence, round(n * baskets / (s1.s * s2.s), 9) AS lift FROM dr JOIN sp s1 ON s1.p = dr.a JOIN sp s2 ON s2.p = dr.b, nn WHERE n >= 2),
r AS (SELECT f.*, row_number() OVER (PARTITION BY seed_product ORDER BY lift DESC, title, product_id)::INTEGER AS rank FROM f JOIN vis USING (product_id) WHERE confidence >= 0.02) SELECT * FROM r WHERE rank <= 12""")
def frequently_bought(spark, sf_dir):
    v, b = stored_vis(spark, sf_dir), B.baskets(spark, sf_dir)
    return R.frequently_bought(v.select(F.col("product_id").alias("seed_product")), R.build_cooccurrence(b, v, None), R.basket_count(b, v, None), v, least_confidence=0.02)


@query("SELECT count(*) AS baskets FROM (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 10 <> 0 AND p_partkey % 20 <> 3 GROUP BY 1 HAVING count(DISTINCT l_partkey) <= 50)")
def baskets_from(spark, sf_dir):
    return R.basket_count(B.baskets(spark, sf_dir), vis(spark, sf_dir))


@query(f"WITH {_E}, l AS (SELECT session_id, product_id, max(occurred_at) AS at_ FROM event WHERE product_id IS NOT NULL GROUP BY ALL) SELECT session_id, product_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_ DESC, product_id)::INTEGER AS rank FROM l) WHERE rank <= 12")
def recently_viewed(spark, sf_dir):
    return R.recently_viewed(B.events(spark, sf_dir))


@query(f"{DOC_SQL}, rf AS (SELECT l_orderkey AS list_id, l_linenumber AS pos, l_partkey FROM lineitem), h AS (SELECT list_id, product_id, min(pos) AS pos FROM rf JOIN vis ON p_partkey = l_partkey WHERE l_partkey % 3 < 2 GROUP BY ALL) SELECT list_id, product_id, row_number() OVER (PARTITION BY list_id ORDER BY pos, product_id)::INTEGER AS rank FROM h")
def resolve_refs(spark, sf_dir):
    k = F.col("l_partkey")
    p = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey")).alias("h"))
    ref = F.when(k % 3 == 0, F.concat(F.lit("gid://store/Product/"), k)).when(k % 3 == 1, F.upper("h")).otherwise("not a reference")
    return R.resolve_refs(B.table(spark, sf_dir, "lineitem").join(p, "l_partkey").select(F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").alias("pos"), ref.alias("ref")), vis(spark, sf_dir))


@query(None)
def recommend(spark, sf_dir):
    """A request of each type for each seed; the two products before the seed were viewed."""
    v, b = stored_vis(spark, sf_dir), B.baskets(spark, sf_dir)
    seeds = stored(_seeds(spark, sf_dir), "seeds")
    by_seed = lambda df: df.select(F.col("seed_id").alias("seed_product"), "product_id", "rank")
    top = R.trending(_signals(spark, sf_dir, v), v, NOW)
    shelves = {
        "similar": by_seed(R.similar(seeds, v)), "related": by_seed(R.similar(seeds, v, weights=R.RELATED)),
        "trending": top.select("product_id", F.row_number().over(Window.orderBy(F.desc("score"), "title", "product_id")).alias("rank")),
        "fbt": R.frequently_bought(seeds, R.build_cooccurrence(b, v, None), R.basket_count(b, v, None), v, k=24, least_confidence=0.05),
    }
    before = lambda n: F.lpad((F.col("seed_product").cast("long") - n).cast("string"), 9, "0")
    requests = seeds.select("seed_product", F.array(before(1), before(2)).alias("recent"), F.explode(F.array(*map(F.lit, (*R.TYPES, "other")))).alias("type"))
    hidden = v.where("cast(product_id as long) % 40 = 7").select("product_id")
    return R.recommend(requests.select(F.concat_ws("/", "type", "seed_product").alias("request_id"), "type", "seed_product", "recent"), shelves, hidden)


@query(f"""{DOC_SQL}, {_E}, ck AS (SELECT session_id, unnest(list_concat(['type:' || product_type, 'vendor:' || vendor], list_transform(tags[1:10], lambda t: 'tag:' || t))) AS key, floor((DATE '2024-03-05' - occurred_at::DATE) / 30)::INT AS age FROM event JOIN vis USING (product_id) WHERE event_type = 'result_click'),
n AS (SELECT session_id, key, count(*) FILTER (WHERE age = 0) AS c0, count(*) FILTER (WHERE age = 1) AS c1, count(*) FILTER (WHERE age = 2) AS c2 FROM ck GROUP BY ALL), w AS (SELECT session_id, key, (floor((floor(c2 / 2) + c1) / 2) + c0)::INTEGER AS weight FROM n)
SELECT session_id, key, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, key)::INTEGER AS rank FROM w WHERE weight > 0) WHERE rank <= 20""")
def interest_profile(spark, sf_dir):
    e = B.events(spark, sf_dir).where("event_type = 'result_click'")
    return R.interest_profile(e, vis(spark, sf_dir), datetime(2024, 3, 5))


# ---- merchandising: rules derived from suppliers, requests from customers


def _rules(spark, sf_dir):
    k = F.col("s_suppkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    scope = pick("global", "collection", "query_exact", "query_contains", "query_exact")
    value = F.when(scope == "collection", F.concat(F.lit("c"), k % 25)).when(scope == "query_exact", F.concat(F.lit("Customer#00000000"), k % 9)).when(scope == "query_contains", F.concat(F.lit("00"), k % 7))
    return B.table(spark, sf_dir, "supplier").select(
        k.alias("rule_id"), pick("hide", "pin", "boost", "demote").alias("action"), scope.alias("scope_type"), value.alias("scope_value"), (k % 6).alias("priority"), (k % 4).alias("position"), (k % 100).alias("weight"), (k % 11 != 0).alias("enabled"),
        F.when(k % 3 == 0, F.lit(datetime(2024, 1, 1))).alias("starts_at"), F.when(k % 5 == 0, F.when(k % 2 == 0, F.lit(datetime(2024, 1, 31))).otherwise(F.lit(datetime(2024, 3, 1)))).alias("ends_at"), k.alias("created_at"), F.when(k % 2 == 0, F.concat(F.lit("/x/"), k)).otherwise(F.lit("//evil")).alias("link"),
    )


def _asks(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("query_id"), F.col("c_name").alias("query"), F.concat(F.lit("c"), F.col("c_nationkey")).alias("collection_gid"))


_RULE = """ru AS (SELECT s_suppkey AS rule_id, (['hide','pin','boost','demote'])[s_suppkey % 4 + 1] AS action, (['global','collection','query_exact','query_contains','query_exact'])[s_suppkey % 5 + 1] AS scope, s_suppkey % 6 AS priority, s_suppkey % 4 AS position, s_suppkey % 100 AS weight, s_suppkey AS k FROM supplier
 WHERE s_suppkey % 11 <> 0 AND NOT (s_suppkey % 5 = 0 AND s_suppkey % 2 = 0)),
asks AS (SELECT c_custkey AS query_id, lower(replace(c_name, '#', ' ')) AS qn, 'c' || c_nationkey AS cg FROM customer),
sm AS (SELECT * FROM asks, ru WHERE scope = 'global' OR (scope = 'collection' AND cg = 'c' || (k % 25)) OR (scope = 'query_exact' AND qn = 'customer 00000000' || (k % 9)) OR (scope = 'query_contains' AND contains(qn, '00' || (k % 7))))"""


@query(f"WITH {_RULE} SELECT query_id, rule_id FROM sm")
def scope_match(spark, sf_dir):
    return M.scope_match(_asks(spark, sf_dir), _rules(spark, sf_dir).where("enabled").where(M.schedule_active(NOW))).select("query_id", "rule_id")


def _targets(spark, sf_dir):
    r = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rule_id"), F.explode(F.sequence(F.col("s_suppkey") % 30, F.col("s_suppkey") % 30 + 3)).alias("p"))
    return r.select("rule_id", F.lit("gid").alias("target_kind"), F.concat(F.lit("gid://store/Product/"), "p").alias("target_value"))


_PLAN = f"""{DOC_SQL}, {_RULE}, tg AS (SELECT s_suppkey AS rule_id, unnest(range(s_suppkey % 30, s_suppkey % 30 + 4)) AS p FROM supplier), pl AS (SELECT query_id, product_id, action, CASE WHEN action = 'pin' THEN position END AS position, (CASE action WHEN 'boost' THEN least(weight, 90) WHEN 'demote' THEN -least(weight, 90) ELSE 0 END)::BIGINT AS delta, rule_id, priority FROM
 (SELECT sm.*, vis.product_id, row_number() OVER (PARTITION BY query_id, vis.product_id ORDER BY list_position(['hide','pin','boost','demote'], action), priority, rule_id) AS r FROM sm JOIN tg USING (rule_id) JOIN vis ON p_partkey = p) WHERE r = 1)"""


@query(f"{_PLAN} SELECT * FROM pl")
def resolve_merch_plan(spark, sf_dir):
    return M.resolve_merch_plan(_asks(spark, sf_dir), _rules(spark, sf_dir), _targets(spark, sf_dir), vis(spark, sf_dir), NOW)


@query(f"{_PLAN} SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY position, priority, rule_id, product_id)::INTEGER AS pin_rank FROM pl WHERE action = 'pin'")
def pin_order(spark, sf_dir):
    return M.pin_order(resolve_merch_plan(spark, sf_dir)).select("query_id", "product_id", "pin_rank")


@query("SELECT s_suppkey AS rule_id, NOT (s_suppkey % 4 >= 2 AND s_suppkey % 100 NOT BETWEEN 1 AND 90) AS valid FROM supplier")
def validate_rules(spark, sf_dir):
    return M.validate_rules(_rules(spark, sf_dir)).select("rule_id", "valid")


@query(f"WITH {_RULE} SELECT query_id, rule_id, rank, CASE WHEN rule_id % 2 = 0 THEN '/x/' || rule_id END AS link FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, rule_id)::INTEGER AS rank FROM sm) WHERE rank <= 3")
def active_banners(spark, sf_dir):
    return M.active_banners(_asks(spark, sf_dir), _rules(spark, sf_dir), NOW)


@query("""WITH h AS (SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('t1:e1:' || c_custkey, ''), lambda x: ascii(x)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS h FROM customer)
SELECT c_custkey, CASE WHEN h % 100 < 50 THEN 'B' ELSE 'A' END AS variant FROM h""")
def assign_variant(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    return c.select("c_custkey", M.assign_variant(F.lit("t1"), F.lit("e1"), F.col("c_custkey").cast("string"), F.lit(50)).alias("variant"))


@query("SELECT (user_id % 5)::BIGINT AS experiment_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, count(*) FILTER (WHERE event_type = 'view') AS exposures, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events WHERE user_id % 5 IN (1, 2) GROUP BY ALL")
def exposure_counts(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    b = e.select((F.col("user_id") % 5).alias("experiment_id"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("variant"), F.when(F.col("event_type") == "view", "exposure").otherwise(F.col("event_type")).alias("kind"))
    x = B.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("experiment_id"), F.when(F.col("r_regionkey").isin(1, 2), "running").otherwise("ended").alias("status"))
    return M.exposure_counts(b, x)


@query("SELECT r_regionkey::BIGINT AS experiment_id, variant, coalesce(x, 0) AS exposures FROM region LEFT JOIN (SELECT user_id % 5 AS e, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, count(*) FILTER (WHERE event_type = 'view') AS x FROM events WHERE user_id % 5 IN (1, 2) GROUP BY ALL) ON e = r_regionkey")
def exposure_report(spark, sf_dir):
    x = B.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("experiment_id"), F.col("r_regionkey").alias("created_at"))
    return M.exposure_report(x, exposure_counts(spark, sf_dir)).select("experiment_id", "variant", "exposures")


def _badge_rules(spark, sf_dir, kinds):
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, kinds)), (k % len(kinds) + 1).cast("int"))
    value = F.when(kind.isin("gid", "product"), F.concat(F.lit("gid://store/Product/"), k * 3)).when(kind == "collection", F.concat(F.lit("NATION_"), k % 25)).when(kind == "tag", F.concat(F.lit("SIZE-"), k % 50)).when(kind == "handle", F.lit("nothing"))
    return B.table(spark, sf_dir, "supplier").select(k.alias("rule_id"), kind.alias("target_kind"), value.alias("target_value"), k.alias("created_at"), F.lit(None).cast("timestamp").alias("starts_at"), F.when(k % 2 == 0, F.lit(datetime(2024, 1, 30))).otherwise(F.lit(datetime(2024, 2, 9))).alias("ends_at"))


@query(f"""{DOC_SQL}, r AS (SELECT s_suppkey AS rule_id, (['gid','handle','collection','tag'])[s_suppkey % 4 + 1] AS kind, s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 1),
m AS (SELECT product_id, rule_id, kind FROM vis, r WHERE (kind = 'gid' AND gid = 'gid://store/Product/' || (k * 3)) OR (kind = 'collection' AND list_contains(collections, 'NATION_' || (k % 25))) OR (kind = 'tag' AND list_contains(tags, 'size-' || (k % 50))))
SELECT product_id, rule_id, kind AS target_kind FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY list_position(['gid','handle','collection','tag'], kind), rule_id) AS n FROM m) WHERE n = 1""")
def preorder_badges(spark, sf_dir):
    return M.preorder_badges(vis(spark, sf_dir), _badge_rules(spark, sf_dir, ("gid", "handle", "collection", "tag")), NOW)


@query(f"""{DOC_SQL}, r AS (SELECT s_suppkey AS rule_id, (['product','collection','global'])[s_suppkey % 3 + 1] AS kind, s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2024-01-30' ELSE TIMESTAMP '2024-02-09' END AS ends_at FROM supplier),
m AS (SELECT product_id, rule_id, kind, ends_at FROM vis, r WHERE kind = 'global' OR (kind = 'product' AND gid = 'gid://store/Product/' || (k * 3)) OR (kind = 'collection' AND list_contains(collections, 'NATION_' || (k % 25))))
SELECT product_id, rule_id, kind AS target_kind, ends_at <= TIMESTAMP '2024-01-31' AS expired FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY list_position(['product','collection','global'], kind), ends_at, rule_id) AS n FROM m) WHERE n = 1""")
def countdowns(spark, sf_dir):
    return M.countdowns(vis(spark, sf_dir), _badge_rules(spark, sf_dir, ("product", "collection", "global")), NOW)
