"""Mixing sources to target weights with DataFrame functions only.

Size of a document: its number of words (``[^\\x20\\x09-\\x0D]+``; null text: 0).
Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ...  Their targets
share the sum of all sizes by weight; a target is at most three times its source's
size, and what exceeds that is shared again by weight among the others until none
is above.  With rate = target / source size a document is taken floor(rate) times
and once more with probability rate - floor(rate), decided by a hash of the seed,
its doc_id and its source, so that reruns agree.

Repeated rows have one fate.  Empty documents and sources of size 0 have target
and taken 0.  Sources are aggregated before any exchange; the table of sources
holds one row each, is counted, and is broadcast up to ``BROADCAST_SOURCES`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shuffle import cut, fresh

SEED = 20240131
CAP = 3.0
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """source, source_size -> source, source_size, target; one row for each source.

    The weight level at which a source meets its cap is cap * size / weight.  In
    ascending order of that level the capped sources are a prefix: a source is capped
    when its cap is at most its share of what the sources before it leave."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    weighed = weighed.withColumn("level", cap * F.col("source_size") / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = weighed.withColumn("share", share).withColumn("capped", F.col("level") <= F.col("share"))
    t = t.withColumn("rate", F.max(F.when(~F.col("capped"), F.col("share"))).over(everything))
    return t.select("source", "source_size", F.when(F.col("capped"), cap * F.col("source_size")).otherwise(F.col("weight") * F.col("rate")).alias("target"))


def _taken(docs: DataFrame, seed: int, cap: float, names: list[str]) -> DataFrame:
    """docs with four more columns of the given names: size, source size, target, copies."""
    size, source_size, target, copies = names
    source, wide, aim = fresh(docs.withColumns({n: F.lit(None) for n in names}), "mix_source", "mix_size", "mix_target")
    sized = docs.select("*", n_words(F.col("text")).alias(size))
    sources = sized.groupBy("source").agg(F.sum(size).alias("source_size"))
    targets = cut(source_targets(sources, cap).toDF(source, wide, aim), "targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col(source)), "left")
    rate = F.when(F.col(wide) > 0, F.col(aim) / F.col(wide)).otherwise(F.lit(0.0))
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)
    times = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return joined.select(*docs.columns, size, F.col(wide).alias(source_size), F.col(aim).alias(target), times.alias(copies))


def mixed(docs: DataFrame, seed: int = SEED, cap: float = CAP) -> DataFrame:
    """docs (doc_id, text, source) -> all its columns with size, source_size, target and copies in place of columns of these names."""
    own = ["size", "source_size", "target", "copies"]
    return _taken(docs.select(*[c for c in docs.columns if c.lower() not in own]), seed, cap, own)


def emit(docs: DataFrame, seed: int = SEED, cap: float = CAP) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its own columns, whatever their names."""
    names = fresh(docs, "size", "source_size", "target", "copies")
    copies = F.col(names[3])
    taken = _taken(docs, seed, cap, names).where(copies > 0)
    (copy,) = fresh(taken, "copy")
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*docs.columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
l AS (SELECT *, 3.0::DOUBLE * source_size / weight AS level FROM s),
c AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - 3.0::DOUBLE * coalesce(sum(source_size) OVER w, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS share FROM l
      WINDOW w AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT max(share) FILTER (WHERE level > share) AS rate FROM c),
t AS (SELECT source, source_size, CASE WHEN level <= share THEN 3.0::DOUBLE * source_size ELSE weight * rate END AS target FROM c, r),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
      ('0x' || substr(md5('20240131|' || coalesce(d.doc_id::VARCHAR, '') || '|' || coalesce(d.source, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken FROM j
"""
