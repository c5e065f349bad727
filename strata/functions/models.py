"""A registry of trained models: name, version, tags, JSON description and bytes, in a versioned table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dml import VersionedTable

SCHEMA = "name string, version int, tags array<string>, description string, body binary"


class ModelRegistry:
    """Models are few and small; each change is a new snapshot of the table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path)
        if not self.table.versions():
            self.table.commit(spark.createDataFrame([], SCHEMA))

    def store(self, name: str, body: bytes, description: dict, tags: list[str] | None = None) -> int:
        version = (self.list().where(F.col("name") == name).agg(F.max("version")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([(name, version, tags or [], json.dumps(description), bytearray(body))], SCHEMA)
        self.table.commit(self.list().unionByName(row))
        return version

    def list(self, tag: str | None = None) -> DataFrame:
        df = self.table.read()
        return df.where(F.array_contains("tags", tag)) if tag else df

    def get(self, name: str, version: int | None = None):
        """The row of a version, the latest by default; None without one."""
        own = self.list().where(F.col("name") == name)
        own = own.where(F.col("version") == version) if version else own.orderBy(F.desc("version"))
        return own.first()

    def update(self, name: str, version: int, tags: list[str]) -> None:
        hit = (F.col("name") == name) & (F.col("version") == version)
        self.table.commit(self.list().withColumn("tags", F.when(hit, F.array(*[F.lit(t) for t in tags]).cast("array<string>")).otherwise(F.col("tags"))))

    def delete(self, name: str, version: int | None = None) -> None:
        hit = F.col("name") == name if version is None else (F.col("name") == name) & (F.col("version") == version)
        self.table.commit(self.list().where(~hit))
