"""Streams give what the batch transforms give."""

from datetime import datetime

from conftest import SF
from pyspark.sql import functions as F

from commerce_lake.operators import analytics as A
from commerce_lake.operators import restock as RS
from commerce_lake.sources import bridge as B
from commerce_lake.streaming import streams as S


def stream_of(spark, df, tmp_path, name="in"):
    df.coalesce(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)


def test_dedupe_and_append(spark, tmp_path):
    e = B.events(spark, SF).select("tenant_id", "event_id", "event_type", "occurred_at")
    s = S.dedupe_stream(stream_of(spark, e.unionByName(e), tmp_path))
    q = S.append_events(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == e.count() and {r.event_month for r in got.select("event_month").distinct().collect()} == {"2024_01"}


def test_daily_counts(spark, tmp_path):
    e = B.events(spark, SF)
    drain(S.daily_counts(stream_of(spark, e, tmp_path)), "daily", "complete")
    want = A.daily_trend(e)
    got = spark.table("daily").select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_attribution(spark, tmp_path):
    e = B.events(spark, SF).withColumn("session_id", F.lit("s")).withColumn("product_id", F.lit("p"))
    drain(S.attribute_stream(stream_of(spark, e, tmp_path)), "carts")
    got = {r.event_id: r.c for r in spark.table("carts").groupBy("event_id").agg(F.max(F.struct("clicked_at", "click_id")).alias("m")).select("event_id", F.col("m.click_id").alias("c")).collect()}
    want = {r.event_id: r.click_id for r in A.attribute_carts(e).where("click_id is not null").collect()}
    assert got == want and want


def test_last_click(spark, tmp_path):
    """In three batches, rows out of order within the delay; the last file moves the watermark past all carts."""
    S.use_rocksdb(spark)
    try:
        e = B.events(spark, SF).where(F.col("event_type").isin(*A.CLICKS, A.CART)).withColumn("session_id", F.lit("s")).withColumn("product_id", F.concat(F.lit("p"), F.crc32(F.col("event_id").cast("string").cast("binary")) % 3))
        late = e.limit(1).withColumn("occurred_at", F.lit(datetime(2030, 1, 1))).withColumn("event_type", F.lit(A.CLICKS[0])).withColumn("event_id", F.lit("-1").cast(e.schema["event_id"].dataType))
        last, k = e.agg(F.max("occurred_at")).first()[0], F.col("occurred_at")
        middle = last - (last - e.agg(F.min("occurred_at")).first()[0]) / 2
        parts = [e.where(k < F.lit(middle)), e.where(k >= F.lit(middle)), late]
        folder = str(tmp_path / "in")
        (tmp_path / "in").mkdir()
        out = S.last_click_stream(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder))
        for i, part in enumerate(parts):
            part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(folder)
            q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
        got = sorted((r.event_id, r.click_id, r.click_surface) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        want = sorted((str(r.event_id), r.click_id and str(r.click_id), r.click_surface) for r in A.attribute_carts(e).collect())
        key = lambda r: tuple(x or "" for x in r)
        assert sorted(got, key=key) == sorted(want, key=key) and any(r[1] for r in want) and any(r[1] is None for r in want)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_transitions(spark, tmp_path):
    S.use_rocksdb(spark)
    try:
        t = lambda h: datetime(2024, 1, 1, h)
        rows = [(p, "", i, t(1 + (i * 7 + j) % 20), (i + j) % 3 > 0) for j, p in enumerate("abc") for i in range(12)]
        obs = spark.createDataFrame(rows, "product_id string, variant_key string, seq long, source_at timestamp, available boolean")
        drain(S.transitions_stream(stream_of(spark, obs, tmp_path)), "flips")
        want = {(r.product_id, r.seq, r.epoch) for r in RS.availability_transitions(obs).collect()}
        assert {(r.product_id, r.seq, r.epoch) for r in spark.table("flips").collect()} == want and want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_upserts(spark, tmp_path):
    schema = "id int, v int, at timestamp, deleted_at timestamp"
    t = lambda h: datetime(2024, 1, 1, h)
    held = {"df": spark.createDataFrame([(1, 1, t(5), None)], schema)}

    def write(df):
        held["df"] = spark.createDataFrame(df.collect(), df.schema)

    u = spark.createDataFrame([(1, 2, t(4), None), (2, 3, t(1), None), (2, 4, t(2), None)], schema)
    q = S.upsert_stream(stream_of(spark, u, tmp_path), lambda: held["df"], write, ["id"], "at", str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert {(r.id, r.v) for r in held["df"].collect()} == {(1, 1), (2, 4)}
