"""Event sourcing over append-only tables: stream_id, stream_sequence, global_sequence, event_type, payload, ts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def append(log: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """log with the new events (stream_id, event_type, payload, ts and `order`), numbered after what is there.

    Stream numbers come from a window per stream; global numbers from a range partitioning by `order`:
    each partition's first number is the count before it, so no task sees all events.
    """
    ends = log.groupBy("stream_id").agg(F.max("stream_sequence").alias("__end"))
    last = log.agg(F.coalesce(F.max("global_sequence"), F.lit(0)).alias("__last"))
    per = Window.partitionBy("stream_id").orderBy(*order)
    rows = new.withColumn("__k", F.row_number().over(per)).join(ends, "stream_id", "left")
    rows = rows.withColumn("stream_sequence", (F.col("__k") + F.coalesce("__end", F.lit(0))).cast("long"))
    rows = global_sequence(rows, order).crossJoin(F.broadcast(last)).withColumn("global_sequence", F.col("__global") + F.col("__last"))  # one row
    return log.unionByName(rows.select(*log.columns))


def global_sequence(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds __global: 1..n in order, without a gap."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "sequence")
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select("__p", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    within = Window.partitionBy("__p").orderBy(*order)
    return ranged.withColumn("__r", F.row_number().over(within)).join(F.broadcast(before), "__p").withColumn("__global", (F.col("__b") + F.col("__r")).cast("long")).drop("__p", "__b", "__r")


def read_stream(log: DataFrame, stream, first: int, last: int) -> DataFrame:
    """Inclusive range of one stream, in order."""
    return log.where((F.col("stream_id") == F.lit(stream)) & F.col("stream_sequence").between(first, last)).orderBy("stream_sequence")


def read_all(log: DataFrame, after: int, limit: int) -> DataFrame:
    """The next `limit` events with global_sequence > after."""
    return log.where(F.col("global_sequence") > after).orderBy("global_sequence").limit(limit)


def read_page(log: DataFrame, after: int, limit: int) -> DataFrame:
    """read_all with `total`, the number of events in the whole log."""
    total = log.agg(F.count(F.lit(1)).alias("total"))
    return read_all(log, after, limit).crossJoin(F.broadcast(total))  # one row


def stream_length(log: DataFrame) -> DataFrame:
    return log.groupBy("stream_id").agg(F.max("stream_sequence").alias("length"))


def snapshot_due(sequence: Column, every: int) -> Column:
    return sequence % every == 0


def latest_snapshot(snapshots: DataFrame, most: Column | None = None) -> DataFrame:
    """Per stream the snapshot of the highest version (up to `most`)."""
    rows = snapshots.where(F.col("version") <= most) if most is not None else snapshots
    return rows.groupBy("stream_id").agg(F.max("version").alias("version"), F.max_by("state", "version").alias("state"))


def load_with_snapshot(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each stream's latest snapshot and how many events follow it, with their sum of `value` as state."""
    tail = log.join(latest_snapshot(snapshots), "stream_id", "left").where("version IS NULL OR stream_sequence > version")
    after = tail.groupBy("stream_id").agg(F.count(F.lit(1)).alias("tail"), F.sum("value").alias("added"))
    base = stream_length(log).join(latest_snapshot(snapshots), "stream_id", "left").join(after, "stream_id", "left")
    state = F.coalesce("state", F.lit(0.0)) + F.coalesce("added", F.lit(0.0))
    return base.select("stream_id", "length", F.coalesce("tail", F.lit(0)).alias("tail"), state.alias("state"))


def upcast(log: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        log = log.transform(step)
    return log


def rehydrate(log: DataFrame, fold: Callable[[Column, Column], Column], start: Column, value: str = "value") -> DataFrame:
    """Per stream the fold of its values in order (a stream's events fit one task: they are one aggregate's)."""
    ordered = F.array_sort(F.collect_list(F.struct("stream_sequence", F.col(value).alias("v"))))
    return log.groupBy("stream_id").agg(ordered.alias("e")).select("stream_id", F.aggregate("e", start, lambda s, x: fold(s, x["v"])).alias("state"))


def projection_lag(log: DataFrame, checkpoint: int) -> DataFrame:
    """head, checkpoint, lag."""
    return log.agg(F.coalesce(F.max("global_sequence"), F.lit(0)).alias("head")).select("head", F.lit(checkpoint).cast("long").alias("checkpoint"), (F.col("head") - checkpoint).alias("lag"))


class Outbox:
    """Messages with attempts: pending until published, dead after `most` failures; retry delays double."""

    def __init__(self, most: int = 5, delay_s: int = 30):
        self.most, self.delay_s = most, delay_s

    def due(self, box: DataFrame, now: Column) -> DataFrame:
        return box.where((F.col("status") == "pending") & (F.col("next_attempt") <= now))

    def settle(self, box: DataFrame, results: DataFrame, now: Column) -> DataFrame:
        """results: message_id, ok, error -> the box after these attempts."""
        joined = box.join(results, "message_id", "left")
        tries = F.col("attempts") + F.when(F.col("ok").isNotNull(), 1).otherwise(0)
        status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "published").when(tries >= self.most, "dead").otherwise("pending")
        wait = F.when(F.col("ok") == F.lit(False), now + F.make_dt_interval(secs=(self.delay_s * F.pow(F.lit(2), tries - 1)).cast("decimal(18,6)"))).otherwise(F.col("next_attempt"))
        return joined.select("message_id", status.alias("status"), tries.cast("int").alias("attempts"), F.coalesce("error", "last_error").alias("last_error"), wait.alias("next_attempt"))
