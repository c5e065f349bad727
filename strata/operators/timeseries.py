"""Time-series operators over rows (ts, value) and more."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds from 0001-01-01 to 1970-01-01: buckets count from year 1, a Monday.
YEAR_ONE = 62135596800


def _seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, exact to the microsecond."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def _at(seconds: Column, like: str = "timestamp_ntz") -> Column:
    return F.timestamp_micros((seconds * 1_000_000).cast("long")).cast(like)


def in_range(df: DataFrame, ts: str, start: str, end: str, low: float | None = None, high: float | None = None, value: str = "value") -> DataFrame:
    """Half-open [start, end), with optional bounds on the value; the filter reaches the scan."""
    kind = dict(df.dtypes)[ts]
    out = df.where((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))
    if low is not None:
        out = out.where(F.col(value) >= low)
    return out.where(F.col(value) <= high) if high is not None else out


def stats(ts: str = "ts", value: str = "value", tie: str | None = None) -> list[Column]:
    """count, sum, avg, min, max, first, last, stddev (0 for one point). `tie` orders points of one time."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    v = F.col(value)
    spread = F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)))
    return [F.count(v).alias("n"), F.sum(v).alias("sum"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), F.min_by(v, order).alias("first"), F.max_by(v, order).alias("last"), spread.alias("stddev")]


def anchored_bucket(ts: str, start: str, seconds: int) -> Column:
    """Start of the step that holds ts, steps counted from `start`."""
    base = _seconds(F.lit(start).cast("timestamp_ntz"))
    return _at(base + F.floor((_seconds(F.col(ts)) - base) / seconds) * seconds)


def interval_bucket(ts: str, seconds: int) -> Column:
    """Start of the step that holds ts, steps counted from year 1."""
    return _at(F.floor((_seconds(F.col(ts)) + YEAR_ONE) / seconds) * seconds - YEAR_ONE)


def date_bucket(ts: str, unit: str) -> Column:
    """Day, week (from Monday), month, quarter or year."""
    return F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")


def group_by_interval(df: DataFrame, start: str, end: str, seconds: int, ts: str = "ts", value: str = "value", tie: str | None = None) -> DataFrame:
    """Full statistics per step of [start, end); empty steps are left out."""
    return in_range(df, ts, start, end).groupBy(anchored_bucket(ts, start, seconds).alias("bucket")).agg(*stats(ts, value, tie))


def downsample(df: DataFrame, start: str, end: str, seconds: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """avg per step of [start, end), every step present (NULL if empty), the last one clipped at end."""
    spark = df.sparkSession
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    last = F.ceil((_seconds(hi) - _seconds(lo)) / seconds) - 1
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    spine = spine.select(_at(_seconds(lo) + F.col("k") * seconds).alias("bucket"))
    spine = spine.withColumn("bucket_end", F.least(_at(_seconds(F.col("bucket")) + seconds), hi))
    points = in_range(df, ts, start, end).groupBy(anchored_bucket(ts, start, seconds).alias("bucket")).agg(F.avg(value).alias("avg"), F.count(value).alias("n"))
    return spine.join(points, "bucket", "left").select("bucket", "bucket_end", "avg", F.coalesce("n", F.lit(0)).alias("n"))


def bucket_id(table: str, ts: str, granularity: str) -> Column:
    """Name of the storage bucket: table, granularity, time."""
    formats = {"minute": "yyyyMMddHHmm", "hour": "yyyyMMddHH", "day": "yyyyMMdd", "month": "yyyyMM"}
    text = F.date_format(F.date_trunc("week", F.col(ts)), "yyyyMMdd") if granularity == "week" else F.date_format(ts, formats[granularity])
    return F.concat(F.lit(f"{table}_{granularity.capitalize()}_"), text)


def weighted_avg(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def percentile_100(value: str, p: float) -> Column:
    """Percentile for p in 0..100; NaN on no points."""
    return F.coalesce(F.percentile(value, p / 100.0), F.lit(float("nan")))


@dataclass(frozen=True)
class Retention:
    """Tiers by age in days, and downsampling rules (age in days -> seconds per step). Ages and limits may be parts of a day."""

    hot_days: int
    warm_days: int
    cold_days: int
    rules: tuple[tuple[int, int], ...] = ()

    def tier(self, age_days: Column) -> Column:
        return F.when(age_days < self.hot_days, "hot").when(age_days < self.warm_days, "warm").when(age_days < self.cold_days, "cold").otherwise("expired")

    def purge(self, df: DataFrame, age_days: Column) -> DataFrame:
        return df.where(age_days < self.cold_days)

    def step_seconds(self, age_days: Column) -> Column:
        """The step of the rule with the largest age that is reached; NULL if none is."""
        out = F.lit(None).cast("int")
        for age, seconds in sorted(self.rules):
            out = F.when(age_days >= age, F.lit(seconds)).otherwise(out)
        return out


def age_in_days(ts: Column, now: Column) -> Column:
    """Days and parts of a day between ts and now."""
    return (_seconds(now) - _seconds(ts)) / 86400.0


#: Presets: what is asked of short-lived, ordinary and long-kept series.
PRESETS = {
    "live": Retention(1 / 24, 1, 7, ((1 / 24, 60), (1, 300))),
    "short": Retention(1, 7, 30, ((1, 60), (7, 3600))),
    "standard": Retention(7, 30, 365, ((7, 300), (30, 3600))),
    "long": Retention(30, 365, 3650, ((30, 3600), (365, 86400))),
}


def apply_downsampling(df: DataFrame, policy: Retention, age_days: Column, ts: str = "ts", value: str = "value") -> DataFrame:
    """Rows that no rule reaches as they are; older rows as one mean per step."""
    step = policy.step_seconds(age_days)
    rows = df.select(F.col(ts).alias("ts"), F.col(value).alias("value"), step.alias("step"))
    raw = rows.where("step IS NULL").select("ts", "value", F.lit(1).cast("long").alias("n"))
    start = _at(F.floor((_seconds(F.col("ts")) + YEAR_ONE) / F.col("step")) * F.col("step") - YEAR_ONE)
    rolled = rows.where("step IS NOT NULL").groupBy(start.alias("ts"), "step").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return raw.unionByName(rolled.select("ts", "value", "n"))


def rollup_stats(df: DataFrame, ts: str, seconds: int, value: str = "value") -> DataFrame:
    """Per step from year 1: points, and how many points one row stands for."""
    per = df.groupBy(interval_bucket(ts, seconds).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("points"), F.count(F.lit(1)).alias("buckets"), (F.sum("n") / F.count(F.lit(1))).alias("ratio"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Each left row with the last right row at or before it, by one shuffle: both sides in one window, no pairs."""
    cols = [c for c in right.columns if c not in keys and c != ts]
    if set(cols) & set(left.columns):
        raise ValueError("columns of both sides clash")
    l_rows = left.select("*", F.lit(1).alias("__side"), *[F.lit(None).cast(dict(right.dtypes)[c]).alias(f"__{c}") for c in cols], F.lit(None).cast(dict(right.dtypes)[ts]).alias("__at"))
    fill = [F.lit(None).cast(dict(left.dtypes)[c]).alias(c) if c not in keys and c != ts else F.col(c) for c in left.columns]
    r_rows = right.select(*fill, F.lit(0).alias("__side"), *[F.col(c).alias(f"__{c}") for c in cols], F.col(ts).alias("__at"))
    w = Window.partitionBy(*keys).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(f"__{c}", True).over(w).alias(c) for c in cols]
    both = l_rows.unionByName(r_rows).select(*left.columns, "__side", *last, F.last("__at", True).over(w).alias("matched_at"))
    return both.where("__side = 1").drop("__side")
