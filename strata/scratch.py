"""Cutting lineage through tables in the folder that all executors share.

Spark's own folder setting ``spark.checkpoint.dir`` names that place. It is read
from the session; only where it is unset (a local session, as in tests) is a
temporary folder chosen.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's switch for deleting a plan's shuffle files when it ends, and not when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="strata-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/strata/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: later plans start from files that outlive executors.

    The shuffle files of df's plan go once it is written. keep: the table stays when a ``temporary`` block ends.
    """
    path = _new_table(df.sparkSession, tag, keep)
    with _shuffles_cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_buckets(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """Like materialize, in hash buckets of key, each row once: joins on the key leave these rows where they are.

    A bucket is one task. buckets should be at least spark.sql.shuffle.partitions, or Spark may shuffle the rows again.
    """
    spark, name = df.sparkSession, f"strata_{uuid.uuid4().hex}"
    path = _new_table(spark, tag, False)
    with _shuffles_cleaned(spark):
        df.repartition(buckets, key).distinct().write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay, as the table is external
    return out


def tasks_for(df: DataFrame, times: int = 1, rows: int = 1_000_000) -> int:
    """Tasks that hold about `rows` rows each of `times` df (counted), at least spark.sql.shuffle.partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * times // rows))


def _new_table(spark: SparkSession, tag: str, keep: bool) -> str:
    path = scratch_path(spark, tag)
    if not keep and getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    return path


@contextmanager
def _shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What this thread materializes in the block is deleted at its end, except tables to keep; no plan may read it afterwards."""
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        paths, _open.paths = _open.paths, outer
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete this application's scratch tables; nothing that still reads from them may be used afterwards."""
    _delete(spark, f"{shared_dir(spark)}/strata/{spark.sparkContext.applicationId}")
