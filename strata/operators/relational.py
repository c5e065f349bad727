"""Relational helpers that plain DataFrame calls do not name."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize

#: Collation names and Spark's collations for them.
COLLATIONS = {"BINARY": "UTF8_BINARY", "NOCASE": "UTF8_LCASE", "RTRIM": "UTF8_BINARY_RTRIM", "UNICODE_CI": "UNICODE_CI"}


def collated(column: str | Column, collation: str) -> Column:
    """The column under a collation: BINARY, NOCASE, RTRIM, UNICODE_CI or a locale such as 'fr'."""
    col = F.col(column) if isinstance(column, str) else column
    return F.collate(col, COLLATIONS.get(collation.upper(), f"{collation}_CI_AI" if len(collation) <= 3 else collation))


def optionally(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as struct(is_some, value)."""
    return df.withColumns({c: F.struct(F.col(c).isNotNull().alias("is_some"), F.col(c).alias("value")) for c in columns})


def unwrap(column: str, default: object) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


def bound(spark: SparkSession, sql: str, params: dict, **frames: DataFrame) -> DataFrame:
    """SQL with named parameters; values never become SQL text."""
    return spark.sql(sql, args=params, **frames)


def with_expressions(df: DataFrame, **expressions: str) -> DataFrame:
    """Derived columns: what an expression index stores."""
    return df.withColumns({k: F.expr(v) for k, v in expressions.items()})


def partial(df: DataFrame, predicate: str) -> DataFrame:
    """The rows that a partial index holds."""
    return df.where(predicate)


@dataclass(frozen=True)
class TenantPolicy:
    """Row-level security by a discriminator column."""

    column: str
    tenant: object

    def read(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.column) == F.lit(self.tenant))

    def violations(self, df: DataFrame) -> DataFrame:
        """Rows that this tenant may not write."""
        return df.where(~F.col(self.column).eqNullSafe(F.lit(self.tenant)))

    def check(self, df: DataFrame) -> DataFrame:
        """df, failing at run time on the first row of another tenant."""
        wrong = ~F.col(self.column).eqNullSafe(F.lit(self.tenant))
        return df.withColumn(self.column, F.when(wrong, F.raise_error(F.lit("row of another tenant")).cast(df.schema[self.column].dataType)).otherwise(F.col(self.column)))


def create_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


class MaterializedView:
    """A kept result: refreshed manually, on access, after a period, or at each change."""

    def __init__(self, build: Callable[[], DataFrame], strategy: str = "manual", period_s: float = 300.0):
        if strategy not in ("manual", "on_access", "periodic", "immediate"):
            raise ValueError(strategy)
        self.build, self.strategy, self.period_s = build, strategy, period_s
        self._df: DataFrame | None = None
        self._at = 0.0
        self.refresh()

    def refresh(self) -> None:
        """The result is written to the shared folder: it outlives executors and later changes of its base tables."""
        self._df, self._at = materialize(self.build(), "view"), time.monotonic()

    def changed(self) -> None:
        """To be called after a base table changed."""
        if self.strategy == "immediate":
            self.refresh()

    def read(self) -> DataFrame:
        late = self.strategy == "periodic" and time.monotonic() - self._at > self.period_s
        if late or self.strategy == "on_access":
            self.refresh()
        return self._df


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL matches NULL; the keys come from the left side. It stays a hash or merge join."""
    r = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def join_diagnostics(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: keys of each side with and without a partner. Keys are counted per side first, so no pair is built."""
    side = lambda df, key, name: df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias(name))
    both = side(left, left_key, "nl").join(side(right, right_key, "nr"), "k", "full")
    n = lambda cond: F.count(F.when(cond, 1))
    has_l, has_r = F.col("nl").isNotNull(), F.col("nr").isNotNull()
    return both.agg(
        n(has_l & has_r).alias("matched_left"),
        n(has_l & ~has_r).alias("unmatched_left"),
        n(has_r & ~has_l).alias("unmatched_right"),
        F.coalesce(F.sum(F.col("nl") * F.col("nr")), F.lit(0)).alias("pairs"),
    )
