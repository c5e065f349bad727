"""How queries are registered: by SQL for both engines, or by code with the SQL it must equal."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

Table = Callable[[str], DataFrame]
Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, spark_sql: str, duck_sql: str | None = None) -> None:
        """A query as Spark SQL, and as the other engine's SQL where that differs."""
        used = [t for t in TABLES if re.search(rf"\b{t}\b", spark_sql)]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for t in used:
                spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
            return spark.sql(spark_sql)

        self._add(name, run, duck_sql or spark_sql)

    def code(self, name: str, duck_sql: str | None = None) -> Callable[[Callable[[Table], DataFrame]], Callable[[Table], DataFrame]]:
        """A query as a function of a table loader."""

        def keep(build: Callable[[Table], DataFrame]) -> Callable[[Table], DataFrame]:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return build(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

            self._add(name, run, duck_sql)
            return build

        return keep

    def _add(self, name: str, run: Query, oracle: str | None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = run
        if oracle:
            self.oracles[name] = oracle
