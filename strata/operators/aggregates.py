"""Aggregates beyond Spark's own names, and OLAP shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: Column | str) -> Column:
    """SUM as double, 0.0 on no rows."""
    return F.coalesce(F.sum(_c(x).cast("double")), F.lit(0.0))


def percentile(x: Column | str, p: float) -> Column:
    """Exact, interpolated at p (n - 1); p is clamped to [0, 1]."""
    return F.percentile(_c(x), min(1.0, max(0.0, p)))


def approx_percentile(x: Column | str, p: float, accuracy: int = 10_000) -> Column:
    """Mergeable sketch with bounded memory: for columns whose distinct values do not fit one task."""
    return F.percentile_approx(_c(x), min(1.0, max(0.0, p)), accuracy)


def mode(x: Column | str) -> Column:
    """The most frequent value, the smallest on ties."""
    return F.mode(_c(x), True)


def corr(x: Column | str, y: Column | str) -> Column:
    """NULL for fewer than two pairs or without variance.

    A constant has equal least and greatest values; its merged variance can be a rounding error above 0.
    """
    a, b = _c(x), _c(y)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    flat = ((F.min(a) == F.max(a)) & ~F.isnan(F.min(a))) | ((F.min(b) == F.max(b)) & ~F.isnan(F.min(b)))
    return F.when((F.count(a) > 1) & ~flat, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def covar_samp(x: Column | str, y: Column | str) -> Column:
    """NULL for fewer than two pairs."""
    return F.covar_samp(_c(x), _c(y))


def filtered(agg, x: Column | str, where: Column) -> Column:
    """agg(x) FILTER (WHERE ...), also usable with over()."""
    return agg(F.when(where, _c(x)))


def histogram(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """bucket (1..n), count, low, high: equal widths between the column's least and greatest value."""
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    rows = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span))  # one row: an aggregate without keys
    width = (F.col("hi") - F.col("lo")) / buckets
    place = F.when(width == 0, F.lit(1)).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / width) + 1, F.lit(buckets)))
    grouped = rows.groupBy(place.cast("int").alias("bucket"), "lo", width.alias("w")).agg(F.count(F.lit(1)).alias("count"))
    return grouped.select("bucket", "count", (F.col("lo") + (F.col("bucket") - 1) * F.col("w")).alias("low"), (F.col("lo") + F.col("bucket") * F.col("w")).alias("high"))


def pivot(df: DataFrame, rows: str, columns: str, measure: Column, values: list | None = None) -> DataFrame:
    """Two dimensions by one measure: a row per value of `rows`, a column per value of `columns` (sorted; NULL as 'NULL')."""
    keyed = df.withColumns({rows: F.coalesce(F.col(rows).cast("string"), F.lit("NULL")), columns: F.coalesce(F.col(columns).cast("string"), F.lit("NULL"))})
    grouped = keyed.groupBy(rows)
    return (grouped.pivot(columns, values) if values is not None else grouped.pivot(columns)).agg(measure)


def cube(df: DataFrame, dims: list[str], *aggs: Column) -> DataFrame:
    return df.cube(*dims).agg(*aggs)


def rollup(df: DataFrame, dims: list[str], *aggs: Column) -> DataFrame:
    return df.rollup(*dims).agg(*aggs)


def percentiles_by_rank(df: DataFrame, groups: list[str], column: str, ps: dict[str, float]) -> DataFrame:
    """groups and one column per entry of ps (name -> p): exact interpolated percentiles for groups of any size.

    percentile() holds a group's distinct values in one task. Here rows are first counted per (group, value),
    so a frequent value is one row; those rows are range-partitioned by
    (group, value), so a hot group spreads over tasks; each task sums up its own counts, the counts before a
    task (tasks x groups small rows) shift them, and only the values at the wanted places meet.
    """
    from ..scratch import materialize

    rows = df.select(*groups, F.col(column).cast("double").alias("__v")).where("__v IS NOT NULL")
    counted = rows.groupBy(*groups, "__v").agg(F.count(F.lit(1)).alias("__k"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(counted.repartitionByRange(parts, *groups, "__v").withColumn("__p", F.spark_partition_id()), "percentile")
    counts = ranged.groupBy("__p", *groups).agg(F.sum("__k").alias("__c"))
    group = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("__c").over(group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("__p", *groups, before.alias("__b"), F.sum("__c").over(group).alias("__n"))
    same = F.lit(True)
    named = shifts.select(F.col("__p").alias("__sp"), *[F.col(g).alias(f"__s{i}") for i, g in enumerate(groups)], "__b", "__n")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__s{i}"))
    upto = F.sum("__k").over(Window.partitionBy("__p", *groups).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("__u", upto).join(named, (F.col("__p") == F.col("__sp")) & same)
    placed = placed.withColumn("__last", F.col("__b") + F.col("__u") - 1).withColumn("__first", F.col("__last") - F.col("__k") + 1)
    places = {name: min(1.0, max(0.0, p)) * (F.col("__n") - 1) for name, p in ps.items()}
    holds = lambda at: (F.col("__first") <= at) & (at <= F.col("__last"))
    wanted, aggs = F.lit(False), []
    for name, at in places.items():
        wanted = wanted | holds(F.floor(at)) | holds(F.ceil(at))
        low = F.max(F.when(holds(F.floor(at)), F.col("__v")))
        high = F.max(F.when(holds(F.ceil(at)), F.col("__v")))
        aggs.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return placed.where(wanted).groupBy(*groups).agg(*aggs)


def modes(df: DataFrame, groups: list[str], column: str, name: str) -> DataFrame:
    """groups and the most frequent value, the smallest on ties: counts per value first, so no group's values meet in one task."""
    counted = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count(F.lit(1)).alias("__k"))
    best = F.min(F.struct((-F.col("__k")).alias("k"), F.col(column).alias("v")))
    return counted.groupBy(*groups).agg(best.alias("__b")).select(*groups, F.col("__b.v").alias(name))


def query_cube(spark, sql: str, rows: str, columns: str, measure: Column, values: list | None = None) -> DataFrame:
    """A pivot of a query's result."""
    return pivot(spark.sql(sql), rows, columns, measure, values)
