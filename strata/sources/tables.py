"""Sources, sinks, catalog and change tracking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_all(spark: SparkSession, folder: str, names: list[str]) -> None:
    for n in names:
        load(spark, folder, n).createOrReplaceTempView(n)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None, rowid: bool = False) -> None:
    """Append rows; with rowid a hidden `_rowid` is added to tables without a key."""
    df = df.withColumn("_rowid", F.uuid()) if rowid and "_rowid" not in df.columns else df
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted on its key: joins and lookups on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


class Layouts:
    """Copies of a table kept in other orders, and hints which of them a lookup by a column reads.

    force: that layout or an error; avoid: not that one; prefer: that one if it serves the column. Without a hint the first
    layout whose key is the column is read, and the base table if there is none.
    """

    def __init__(self, base: DataFrame):
        self.base = base
        self.layouts: dict[str, tuple[str, DataFrame]] = {}
        self.forced: str | None = None
        self.avoided: set[str] = set()
        self.preferred: list[str] = []

    def add(self, name: str, key: str, path: str) -> Layouts:
        """Write a copy sorted by key, so that Parquet statistics leave out what a lookup does not want."""
        self.base.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)
        self.layouts[name] = (key, self.base.sparkSession.read.parquet(path))
        return self

    def force(self, name: str) -> Layouts:
        self.forced = name
        return self

    def avoid(self, name: str) -> Layouts:
        self.avoided.add(name)
        return self

    def prefer(self, name: str) -> Layouts:
        self.preferred.append(name)
        return self

    def choose(self, column: str) -> str | None:
        """The layout that a lookup by this column reads; None is the base table."""
        serving = [n for n, (key, _) in self.layouts.items() if key == column and n not in self.avoided]
        if self.forced is not None:
            if self.forced not in serving:
                raise ValueError(f"layout {self.forced} cannot serve {column}")
            return self.forced
        return next((n for n in [*self.preferred, *serving] if n in serving), None)

    def scan(self, column: str) -> DataFrame:
        name = self.choose(column)
        return self.base if name is None else self.layouts[name][1]


def migrate(spark: SparkSession, source: str, target: str, fmt: str = "parquet", files: int | None = None) -> int:
    """Re-encode a table and check row counts; gives the rows."""
    df = spark.read.parquet(source)
    (df.repartition(files) if files else df).write.mode("overwrite").format(fmt).save(target)
    n, m = df.count(), spark.read.format(fmt).load(target).count()
    if n != m:
        raise ValueError(f"{n} rows became {m}")
    return n


def table_info(spark: SparkSession, name: str) -> DataFrame:
    """cid, name, type, nullable of a table or view."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(spark.table(name).schema.fields)]
    return spark.createDataFrame(rows, "cid int, name string, type string, nullable boolean")


def master(spark: SparkSession) -> DataFrame:
    """Tables and views, as sqlite_master lists them."""
    rows = [("view" if t.isTemporary or t.tableType == "VIEW" else "table", t.name) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "type string, name string")


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Change-tracking rows: the keys and `operation` (insert, update, delete with tombstone). One full join on the keys."""
    others = [c for c in new.columns if c not in keys]
    digest = lambda df, name: df.select(*keys, F.xxhash64(*[F.col(c) for c in others], *[F.col(c).isNull() for c in others]).alias(name))
    both = digest(old, "o").join(digest(new, "n"), keys, "full")
    op = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").otherwise("update")
    return both.where("NOT (o <=> n)").select(*keys, op.alias("operation"), (op == "delete").alias("tombstone"))


def archive(df: DataFrame, path: str, bucket: Column) -> None:
    """Cold rows as partitions by bucket: a range read prunes the others."""
    df.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(path)


def read_archived(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("bucket").between(first, last))


def _folders(spark: SparkSession, path: str, first: str, last: str) -> list:
    """Partition folders of an archive whose bucket lies in the range, as Hadoop paths."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    return [x.getPath() for x in found if x.isDirectory() and x.getPath().getName().startswith("bucket=") and first <= x.getPath().getName()[7:] <= last]


def archive_summary(df: DataFrame) -> DataFrame:
    """bucket, rows, digest (a sum over row hashes, whatever the rows' order) of archived rows."""
    cols = sorted(c for c in df.columns if c != "bucket")
    digest = F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))
    return df.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), digest.alias("digest"))


def verify_archive(source: DataFrame, bucket: Column, path: str) -> DataFrame:
    """Buckets whose archived rows differ from the source's: bucket, rows, archived_rows; none if all is well."""
    want = archive_summary(source.withColumn("bucket", bucket))
    got = archive_summary(source.sparkSession.read.parquet(path)).select("bucket", F.col("rows").alias("archived_rows"), F.col("digest").alias("archived_digest"))
    both = want.join(got, "bucket", "full")
    return both.where("NOT (rows <=> archived_rows AND digest <=> archived_digest)").select("bucket", "rows", "archived_rows")


def restore_archive(spark: SparkSession, path: str, first: str, last: str, target: str) -> int:
    """Append an archive's buckets to a table; gives the rows."""
    rows = read_archived(spark, path, first, last).drop("bucket")
    rows.write.mode("append").parquet(target)
    return rows.count()


def purge_archive(spark: SparkSession, path: str, first: str, last: str) -> int:
    """Delete an archive's buckets; gives how many went."""
    gone = _folders(spark, path, first, last)
    for p in gone:
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(gone)
