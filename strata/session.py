"""Session construction and the settings every operator relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Runtime settings; all of them can be changed on an existing session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "10000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that the caller owns."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def get_spark(app: str = "strata", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, build your own and call configure()."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        **RUNTIME_CONF,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
