"""Shard keys, routing, version clocks and conflict resolution for distributed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_shard(key: Column, shards: int) -> Column:
    """Stable across processes; NULL goes to 0."""
    return F.when(key.isNull(), 0).otherwise(F.pmod(F.hash(key), F.lit(shards)))


def composite_shard(keys: list[Column], shards: int) -> Column:
    return F.pmod(F.hash(*keys), F.lit(shards))


def range_shard(key: Column, upper: list) -> Column:
    """The first shard whose upper bound is >= the key; above all the last one; NULL to 0."""
    out = F.lit(len(upper) - 1)
    for i in range(len(upper) - 1, -1, -1):
        out = F.when(key <= F.lit(upper[i]), i).otherwise(out)
    return F.when(key.isNull(), 0).otherwise(out)


def list_shard(key: Column, shards: dict) -> Column:
    """A shard per value; others to 0."""
    out = F.lit(0)
    for value, shard in shards.items():
        out = F.when(key == F.lit(value), shard).otherwise(out)
    return out


def route(predicates: dict[str, object], shard_key: str, shards: int, assign) -> list[int]:
    """Shards that a query with these equality predicates must ask: one if the key is fixed, else all."""
    if shard_key not in predicates:
        return list(range(shards))
    return [assign(predicates[shard_key])]


def write_sharded(df: DataFrame, shard: Column, path: str) -> None:
    """One folder per shard: an equality on the shard column prunes the others. Each task writes its own rows, a file per shard:
    a shard's rows never meet in one task."""
    df.withColumn("shard", shard).write.mode("overwrite").partitionBy("shard").parquet(path)


def lww(df: DataFrame, keys: list[str], value: str, ts: str, tie: str) -> DataFrame:
    """Last writer wins."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(ts, tie)).alias(value))


def fww(df: DataFrame, keys: list[str], value: str, ts: str, tie: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(ts, tie)).alias(value))


def merge_values(df: DataFrame, keys: list[str], merge: Column, name: str) -> DataFrame:
    """Conflicts merged by an aggregate."""
    return df.groupBy(*keys).agg(merge.alias(name))


def open_conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For a decision by hand: keys with more than one value, and their values in order."""
    values = df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("values"))
    return values.where(F.size("values") > 1)


def resolve(df: DataFrame, keys: list[str], value: str, ts: str, tie: str, strategy: str = "lww", merge: Column | None = None, choose=None) -> DataFrame:
    """Conflicting writes of a key by strategy: lww, fww, merge (an aggregate), custom (choose(versions) -> value, over the
    array of (ts, tie, value) in order), manual (open_conflicts)."""
    if strategy in ("lww", "fww"):
        return (lww if strategy == "lww" else fww)(df, keys, value, ts, tie)
    if strategy == "merge":
        return merge_values(df, keys, merge, value)
    if strategy == "custom":
        versions = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(value).alias("value"))))
        return df.groupBy(*keys).agg(versions.alias("__versions")).select(*keys, choose(F.col("__versions")).alias(value))
    if strategy == "manual":
        return open_conflicts(df, keys, value)
    raise ValueError(strategy)


def clock_merge(a: Column, b: Column) -> Column:
    """The larger count of each node."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def clock_increment(clock: Column, node: str) -> Column:
    return F.map_zip_with(clock, F.create_map(F.lit(node), F.lit(1)), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def happened_before(a: Column, b: Column) -> Column:
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, F.lit(0)) - F.coalesce(x, F.lit(0))))
    return F.forall(both, lambda d: d >= 0) & F.exists(both, lambda d: d > 0)


def concurrent(a: Column, b: Column) -> Column:
    return ~happened_before(a, b) & ~happened_before(b, a) & (F.to_json(a) != F.to_json(b))
