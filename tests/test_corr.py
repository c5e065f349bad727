"""Correlation with a constant, in groups whose tasks' averages merge with a rounding error (49 / 49 < 1)."""

from pyspark.sql import functions as F

from strata.dialect import Database
from strata.operators import aggregates as agg


def test_constant_has_no_correlation(spark):
    rows = spark.range(0, 98, 1, 2).select(F.col("id").cast("double").alias("x"))
    got = rows.agg(agg.corr("x", F.lit(1.0)).alias("a"), agg.corr(F.lit(1.0), "x").alias("b"), F.round(agg.corr("x", F.col("x") * 2), 9).alias("c")).first()
    assert (got.a, got.b, got.c) == (None, None, 1.0)


def test_dialect_constant_has_no_correlation(spark):
    spark.range(0, 98, 1, 2).select(F.col("id").cast("double").alias("x")).createOrReplaceTempView("corr_rows")
    got = Database(spark).query("SELECT CORRELATION(x, 1) AS a, ROUND(CORRELATION(x, x), 9) AS c FROM corr_rows").first()
    assert (got.a, got.c) == (None, 1.0)
