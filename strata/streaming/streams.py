"""Structured Streaming: file streams, windows, sessions, deduplication, projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path


def file_stream(spark: SparkSession, folder: str, table: str, time_column: str | None = None) -> DataFrame:
    """Parquet files as a stream; the event time becomes a timestamp with zone, which watermarks need."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet").parquet(folder)
    return stream.withColumn(time_column, F.col(time_column).cast("timestamp")) if time_column else stream


def tumbling(stream: DataFrame, ts: str, size: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), *keys)


def sliding(stream: DataFrame, ts: str, size: str, step: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size, step), *keys)


def sessions(stream: DataFrame, ts: str, gap: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys)


def deduplicated(stream: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run over all files there are and return the sink's table; 'complete' keeps the last result of each batch."""
    spark = stream.sparkSession
    out = scratch_path(spark, "stream-out")
    schema = stream.schema

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state")).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(out)


class Projection:
    """Events applied in batches by `apply(batch, id)`; the checkpoint makes a restart go on where it stopped (at least once)."""

    def __init__(self, name: str, apply: Callable[[DataFrame, int], None], checkpoint: str):
        self.name, self.apply, self.checkpoint = name, apply, checkpoint

    def run(self, stream: DataFrame):
        """All that is there now; gives the last progress (input rows, batch id)."""
        query = stream.writeStream.queryName(self.name).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).foreachBatch(self.apply).start()
        query.awaitTermination()
        return query.lastProgress

    def start(self, stream: DataFrame, every: str = "5 seconds"):
        """A background worker that polls."""
        return stream.writeStream.queryName(self.name).option("checkpointLocation", self.checkpoint).trigger(processingTime=every).foreachBatch(self.apply).start()
