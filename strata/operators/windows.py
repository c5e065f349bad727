"""Window shapes: rolling, cumulative, filtered; row numbers of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..scratch import materialize, tasks_for


def rolling(agg: Column, partition: list[str], order: list, n: int) -> Column:
    """agg over the last n rows; shorter at the start."""
    return agg.over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(n - 1), 0))


def cumulative(agg: Column, partition: list[str], order: list) -> Column:
    return agg.over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def filtered_over(agg, x: str, where: Column, window: WindowSpec) -> Column:
    """agg(x) FILTER (WHERE ...) OVER (...), which Spark's SQL does not accept."""
    return agg(F.when(where, F.col(x))).over(window)


def frame(partition: list[str], order: list, start: int | None, end: int | None) -> WindowSpec:
    """ROWS BETWEEN start AND end; None is unbounded, negative is preceding."""
    low = Window.unboundedPreceding if start is None else start
    high = Window.unboundedFollowing if end is None else end
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(low, high)


def row_numbers(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """df and row_number() over groups in that order, for groups of any size.

    Rows are range-partitioned by groups and order, about a million to a task, sorted there and written with their place; the
    counts of a group in the tasks before (tasks x groups small rows) shift the places. No task sees a whole group.
    """
    ranged = df.repartitionByRange(tasks_for(df), *groups, *order).sortWithinPartitions(*groups, *order)
    ranged = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), "row-numbers")  # the task's number << 33, plus the place
    task = F.shiftright("__at", 33)
    runs = ranged.groupBy(task.alias("__t"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    same_group = Window.partitionBy(*[f"__g{i}" for i in range(len(groups))]).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__shift", F.coalesce(F.sum("__n").over(same_group), F.lit(0)) + 1 - F.col("__first")).drop("__first", "__n")
    same = task == F.col("__t")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return ranged.join(runs, same).withColumn(name, F.col("__at") + F.col("__shift")).select(*df.columns, name)
