"""Data changes as transforms of tables: every change gives a new DataFrame; VersionedTable keeps snapshots of them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One of the rows of each key, the first by `order`; all rows with a NULL in their key, which never conflicts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    loose = F.lit(False)
    for k in keys:
        loose = loose | F.col(k).isNull()
    return rows.withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | loose).drop("__n")


def insert(target: DataFrame, rows: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """Append; missing columns take their default or NULL."""
    return target.unionByName(with_defaults(rows, target, defaults or {}))


def with_defaults(rows: DataFrame, target: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Rows with all of target's columns; a missing or NULL value takes the default."""
    out = []
    for f in target.schema.fields:
        default = defaults.get(f.name)
        default = (default if isinstance(default, Column) else F.lit(default)).cast(f.dataType)
        out.append((F.coalesce(F.col(f.name).cast(f.dataType), default) if f.name in rows.columns else default).alias(f.name))
    return rows.select(*out)


def new_rows(target: DataFrame, rows: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Rows whose key is new; of several such rows the first by `order`."""
    return first_per_key(rows, keys, order or [F.lit(1)]).join(target.select(*keys), keys, "left_anti").select(*rows.columns)


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    return target.unionByName(new_rows(target, rows, keys, order).select(*target.columns))


def insert_or_replace(target: DataFrame, rows: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """New rows win over old ones of the same key; of several new ones the first by `order` (pass it descending for the last)."""
    fresh = first_per_key(rows, keys, order or [F.lit(1)])
    return target.join(fresh.select(*keys), keys, "left_anti").select(*target.columns).unionByName(fresh.select(*target.columns))


def conflicts(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that INSERT OR FAIL / ABORT would refuse: keys already there, or given twice."""
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*keys)
    return rows.join(target.select(*keys), keys, "left_semi").unionByName(rows.join(twice, keys, "left_semi")).distinct()


def insert_or_abort(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows or an error."""
    if not conflicts(target, rows, keys).isEmpty():
        raise ValueError(f"rows conflict on {keys}")
    return target.unionByName(rows.select(*target.columns))


def _merged(target: DataFrame, rows: DataFrame, keys: list[str], updates: dict[str, str], where: str | None) -> DataFrame:
    """The table after one row per key, with __written: true for rows inserted or updated."""
    t, x = target.withColumn("__t", F.lit(1)), rows.withColumn("__x", F.lit(1))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"target.{k}") == F.col(f"excluded.{k}"))
    joined = t.alias("target").join(x.alias("excluded"), on, "full")
    hit = F.col("__t").isNotNull() & F.col("__x").isNotNull()
    if where:
        hit = hit & F.coalesce(F.expr(where), F.lit(False))
    out = []
    for f in target.schema.fields:
        old, new = F.col(f"target.{f.name}"), F.col(f"excluded.{f.name}") if f.name in rows.columns else F.lit(None)
        value = F.when(hit, F.expr(updates[f.name])) if f.name in updates else F.when(hit, old)
        out.append(value.otherwise(F.when(F.col("__t").isNull(), new).otherwise(old)).cast(f.dataType).alias(f.name))
    return joined.select(*out, (hit | F.col("__t").isNull()).alias("__written"))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str], updates: dict[str, str], where: str | None = None) -> DataFrame:
    """ON CONFLICT (keys) DO UPDATE SET column = expression [WHERE ...]; expressions see target.x and excluded.x.

    One full join. Each key comes at most once in rows; see upsert_in_order for others.
    """
    return _merged(target, rows, keys, updates, where).drop("__written")


def upsert_in_order(target: DataFrame, rows: DataFrame, keys: list[str], updates: dict[str, str], where: str | None, order: list) -> tuple[DataFrame, DataFrame]:
    """The table after the rows came one by one, and the rows as each of them was written.

    Rows of one key are folded in as many rounds as the key with the most rows has, each round one full join.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    loose = F.lit(False)
    for k in keys:
        loose = loose | F.col(k).isNull()
    turns = rows.withColumn("__turn", F.when(loose, 1).otherwise(nth))
    most, written = turns.agg(F.max("__turn").alias("m")).first().m or 0, None
    for turn in range(1, most + 1):
        step = _merged(target, turns.where(F.col("__turn") == turn).select(*target.columns), keys, updates, where)
        own, target = step.where("__written").drop("__written"), step.drop("__written")
        written = own if written is None else written.union(own)
    return target, target.limit(0) if written is None else written


def do_nothing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return insert_or_ignore(target, rows, keys)


def update(target: DataFrame, values: dict[str, str | Column], where: str) -> DataFrame:
    hit = F.coalesce(F.expr(where), F.lit(False))
    new = {c: F.when(hit, v if isinstance(v, Column) else F.expr(v)).otherwise(F.col(c)).alias(c) for c, v in values.items()}
    return target.select(*[new.get(c, F.col(c)) for c in target.columns])


def delete(target: DataFrame, where: str) -> DataFrame:
    return target.where(~F.coalesce(F.expr(where), F.lit(False)))


def returning_updated(target: DataFrame, values: dict[str, str | Column], where: str, *columns: str) -> DataFrame:
    """The changed rows after the update."""
    return update(target.where(F.expr(where)), values, "true").select(*(columns or ["*"]))


def returning_deleted(target: DataFrame, where: str, *columns: str) -> DataFrame:
    return target.where(F.expr(where)).select(*(columns or ["*"]))


def check_violations(df: DataFrame, check: str) -> DataFrame:
    """Rows for which the CHECK is false (NULL passes)."""
    return df.where(~F.coalesce(F.expr(check), F.lit(True)))


def foreign_key_violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose value has no parent; NULL passes."""
    ends = parent.select(F.col(key).alias("__key"))
    return child.where(F.col(column).isNotNull()).join(ends, F.col(column) == F.col("__key"), "left_anti")


class Counters:
    """CHANGES(), TOTAL_CHANGES() and LAST_INSERT_ROWID() of one session."""

    def __init__(self) -> None:
        self.changes = self.total_changes = self.last_insert_rowid = 0

    def record(self, rows: int, last_rowid: int | None = None) -> None:
        self.changes = rows
        self.total_changes += rows
        if last_rowid is not None:
            self.last_insert_rowid = last_rowid


class VersionedTable:
    """Snapshots of a table in numbered Parquet folders; readers keep the version they opened.

    A commit writes a new folder and then a marker row in `log`; a commit that fails leaves
    no marker. begin / rollback are choosing which version is current.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> list:
        try:
            return sorted(self.spark.read.parquet(f"{self.path}/log").collect(), key=lambda r: r.version)
        except Exception as e:  # no commit yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return []
            raise

    def versions(self) -> list[int]:
        return [r.version for r in self._log()]

    def _mark(self, version: int, folders: list[str]) -> int:
        row = self.spark.createDataFrame([(version, folders)], "version int, folders array<string>")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version

    def _write(self, df: DataFrame, version: int) -> str:
        folder = f"{self.path}/data/v{version}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def commit(self, df: DataFrame) -> int:
        """A version that is df."""
        version = (self.versions() or [0])[-1] + 1
        return self._mark(version, [self._write(df, version)])

    def append(self, rows: DataFrame) -> int:
        """A version with more rows: only they are written; what was there is named again."""
        last = self._log()[-1]
        return self._mark(last.version + 1, [*last.folders, self._write(rows.select(*self.read().columns), last.version + 1)])

    def read(self, version: int | None = None) -> DataFrame:
        log = self._log()
        row = next(r for r in reversed(log) if version is None or r.version == version)
        return self.spark.read.schema(self.spark.read.parquet(row.folders[0]).schema).parquet(*row.folders)

    def restore(self, version: int) -> int:
        """Make an older version current again (a rollback that keeps history); nothing is copied."""
        log = self._log()
        return self._mark(log[-1].version + 1, next(r.folders for r in log if r.version == version))

    def compact(self, files: int = 1) -> int:
        return self.commit(self.read().repartition(files))

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the last `keep` versions' data; gives how many went."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsc.hadoopConfiguration()
        log = self._log()
        kept = [(r.version, list(r.folders)) for r in log[-keep:]]
        wanted = {f for _, folders in kept for f in folders}
        old = {f for r in log[:-keep] for f in r.folders} - wanted
        for folder in old:
            p = fs_path(folder)
            p.getFileSystem(conf).delete(p, True)
        frame = self.spark.createDataFrame(kept, "version int, folders array<string>").coalesce(1)
        frame.write.mode("overwrite").parquet(f"{self.path}/log")
        return len(log) - len(kept)
