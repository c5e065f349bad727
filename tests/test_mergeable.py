"""Aggregates of users in mergeable parts, against the same function over whole groups."""

import pandas as pd
from pyspark.sql import functions as F

from strata.functions import udf
from strata.functions.udf import MergeableAggregate

MEAN = MergeableAggregate(
    "n long, s double",
    lambda g: pd.DataFrame({"n": g.count(), "s": g.sum()}),
    lambda g: pd.DataFrame({"n": g["n"].sum(), "s": g["s"].sum()}),
    lambda states: (states["s"] / states["n"]).where(states["n"] > 0),
    "double",
)


def rows(spark):
    k = F.when(F.col("id") % 11 != 3, F.col("id") % 11 + 9007199254740992)
    return spark.range(0, 4000, 1, 3).select("id", k.alias("k"), F.when(F.col("id") % 13 != 5, F.concat(F.lit("x"), F.col("id") % 2)).alias("t"), F.when(F.col("id") % 11 != 7, F.col("id") * 1.0).alias("v"))


def test_groups_and_windows(spark, monkeypatch):
    monkeypatch.setattr(udf, "FOLD_ROWS", 50)
    df = rows(spark)
    want = {(r.k, r.t): r.m and round(r.m, 6) for r in df.groupBy("k", "t").agg(F.avg("v").alias("m")).collect()}
    got = [(r.k, r.t, r.m and round(r.m, 6)) for r in MEAN.by(df, ["k", "t"], "v", "m").collect()]
    assert len(got) == len(want) and {(k, t): m for k, t, m in got} == want
    over = MEAN.over(df, ["k", "t"], "v", "m").collect()
    assert len(over) == 4000 and all((r.m and round(r.m, 6)) == want[r.k, r.t] for r in over)


def test_user_aggregates_of_queries_call_nothing_per_group(spark):
    from strata.plans import registry

    for name in ("udaf", "window_udf"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "spread(" not in plan and "spread_over(" not in plan
