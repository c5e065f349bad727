"""A log sink: records are gathered and appended in batches."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession

SCHEMA = "ts timestamp, level string, message string, properties map<string, string>"


class LogSink:
    """Flushes after `most` records or `seconds`; close() flushes the rest."""

    def __init__(self, spark: SparkSession, path: str, most: int = 1000, seconds: float = 5.0):
        self.spark, self.path, self.most, self.seconds = spark, path, most, seconds
        self.rows: list[tuple] = []
        self.began = time.monotonic()

    def emit(self, ts, level: str, message: str, **properties: str) -> None:
        self.rows.append((ts, level, message, properties))
        if len(self.rows) >= self.most or time.monotonic() - self.began > self.seconds:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.spark.createDataFrame(self.rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        self.rows, self.began = [], time.monotonic()

    close = flush
