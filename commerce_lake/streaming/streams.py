"""Structured Streaming forms: the batch transforms on streaming DataFrames."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import analytics as A
from ..operators import catalog as C

WATERMARK = "1 hour"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State store for keyed processors; it spills to disk and keeps change logs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def dedupe_stream(events: DataFrame, keys: list[str] | None = None, delay: str = WATERMARK) -> DataFrame:
    """The first delivery of each key within the watermark."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(keys or ["tenant_id", "event_id"])


def daily_counts(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Tumbling UTC days of the trend report; late rows beyond the watermark are dropped, the batch re-roll takes them."""
    day = F.window("occurred_at", "1 day")
    t = events.withWatermark("occurred_at", delay).groupBy("tenant_id", day.alias("w"))
    c = t.agg(A._of(A.SEARCH).alias("searches"), A._of(*A.CLICKS).alias("clicks"), A._of(A.ZERO).alias("zero_results"), A._of(A.CART).alias("add_to_carts"))
    return c.select("tenant_id", F.to_date("w.start").alias("day"), "searches", "clicks", "zero_results", "add_to_carts")


def attribute_stream(events: DataFrame, minutes: int = 30, delay: str = WATERMARK) -> DataFrame:
    """Interval join of carts with the clicks of their session and product; the latest click is picked downstream."""
    e = events.where("session_id is not null and product_id is not null").withWatermark("occurred_at", delay)
    clicks = e.where(F.col("event_type").isin(*A.CLICKS)).select(F.col("session_id").alias("c_session"), F.col("product_id").alias("c_product"), F.col("event_id").alias("click_id"), F.col("occurred_at").alias("clicked_at"))
    carts = e.where(F.col("event_type") == A.CART).select("event_id", "session_id", "product_id", "occurred_at")
    inside = (F.col("clicked_at") < F.col("occurred_at")) & (F.col("clicked_at") >= F.col("occurred_at") - F.make_dt_interval(mins=F.lit(minutes)))
    return carts.join(clicks, (F.col("session_id") == F.col("c_session")) & (F.col("product_id") == F.col("c_product")) & inside).select("event_id", "session_id", "product_id", "click_id", "clicked_at")


class LastClick(StatefulProcessor):
    """Clicks and open carts of one tenant, session and product, in the order (time, type, id).

    A cart is answered once the watermark has passed it, when no earlier click can come any more. Of the clicks that the watermark has passed
    only the last is kept, and that one no longer than the look-back, so state holds the delay's events and one click."""

    def __init__(self, minutes: int):
        self.reach = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clicks = handle.getListState("clicks", "at long, event_type string, event_id string, surface string")
        self.carts = handle.getListState("carts", "at long, event_type string, event_id string")

    def handleInputRows(self, key, rows, timers):  # noqa: N802
        for pdf in rows:
            for r in pdf.itertuples():
                if r.event_type == A.CART:
                    self.carts.appendValue((r.at, r.event_type, r.event_id))
                else:
                    self.clicks.appendValue((r.at, r.event_type, r.event_id, r.surface))
                self.handle.registerTimer(r.at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        clicks, carts = sorted(self.clicks.get(), key=lambda c: c[:3]), sorted(self.carts.get())
        out = []
        for cart in (c for c in carts if c[0] < passed):
            before = [c for c in clicks if c[:3] < cart]
            hit = before[-1] if before and before[-1][0] >= cart[0] - self.reach else (None,) * 4
            out.append((key[0], cart[2], key[1], key[2], hit[2], hit[3]))
        old = [c for c in clicks if c[0] < passed][-1:]
        kept = [c for c in old if c[0] >= passed - self.reach] + [c for c in clicks if c[0] >= passed]
        for state, values in ((self.clicks, kept), (self.carts, [c for c in carts if c[0] >= passed])):
            if values:
                state.put(values)
            else:
                state.clear()
        for c in kept[: len(kept) and kept[0][0] < passed]:
            self.handle.registerTimer((c[0] + self.reach) // 1000 + 1)  # forgets it
        yield pd.DataFrame(out, columns=["tenant_id", "event_id", "session_id", "product_id", "click_id", "click_surface"])

    def close(self) -> None:
        pass


def last_click_stream(events: DataFrame, minutes: int = 30, delay: str = WATERMARK) -> DataFrame:
    """attribute_carts on a stream: each add-to-cart once, with the last click before it or none. Needs the RocksDB state store."""
    e = events.where("session_id is not null and product_id is not null").where(F.col("event_type").isin(*A.CLICKS, A.CART)).withWatermark("occurred_at", delay)
    e = e.select(*(F.col(c).cast("string") for c in ("tenant_id", "session_id", "product_id", "event_type", "event_id", "surface")), F.unix_micros("occurred_at").alias("at"), "occurred_at")
    schema = "tenant_id string, event_id string, session_id string, product_id string, click_id string, click_surface string"
    return e.groupBy("tenant_id", "session_id", "product_id").transformWithStateInPandas(LastClick(minutes), schema, "Append", "eventTime")


class Transitions(StatefulProcessor):
    """Keyed state of one target: availability, epoch, newest source time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "available boolean, epoch long, source_at timestamp")

    def handleInputRows(self, key, rows, timers):  # noqa: N802
        old = self.state.get() if self.state.exists() else None
        available, epoch, last = old if old else (None, 0, None)
        out = []
        for pdf in rows:
            for r in pdf.sort_values("seq").itertuples():
                at = None if pd.isna(r.source_at) else r.source_at.to_pydatetime()
                if at is not None and last is not None and at <= last:
                    continue
                if r.available and available is False:
                    epoch += 1
                    out.append((*key, r.seq, at, epoch))
                available = bool(r.available)
                last = at if last is None or (at is not None and at > last) else last
        self.state.update((available, epoch, last))
        yield pd.DataFrame(out, columns=["product_id", "variant_key", "seq", "source_at", "epoch"])

    def close(self) -> None:
        pass


def transitions_stream(observations: DataFrame) -> DataFrame:
    """availability_transitions on a stream, with state that outlives micro-batches."""
    return observations.groupBy("product_id", "variant_key").transformWithStateInPandas(Transitions(), "product_id string, variant_key string, seq long, source_at timestamp, epoch long", "Append", "none")


def upsert_stream(updates: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str], version: str, checkpoint: str) -> StreamingQuery:
    """Order-safe upserts of each micro-batch; a repeated batch applies the same rows again and changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        write(C.monotonic_upsert(read(), batch, keys, version).drop("applied"))

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The month-partitioned event store."""
    return events.withColumn("event_month", A.month_of(F.col("occurred_at"))).writeStream.partitionBy("event_month").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
