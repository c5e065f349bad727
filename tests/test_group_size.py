"""Few large groups: their rows spread over tasks."""

from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.operators import sharding, windows
from strata.plans import registry


def test_a_shard_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 4)
    sharding.write_sharded(rows, (F.col("id") % 2).cast("int"), f"{tmp_path}/out")
    assert len(list(Path(f"{tmp_path}/out/shard=1").glob("*.parquet"))) == 4
    assert spark.read.parquet(f"{tmp_path}/out").where("shard = 1").count() == 500


def test_row_numbers_of_large_groups(spark, monkeypatch):
    kept, real = [], windows.materialize
    monkeypatch.setattr(windows, "materialize", lambda df, tag: kept.append(real(df, tag)) or kept[-1])
    g = F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 50 == 1, "b").otherwise("a")
    rows = spark.range(3000).select("id", g.alias("g"), F.when(F.col("id") % 7 != 2, F.col("id") % 40).alias("x"))
    order = [F.desc("x"), F.col("id")]
    got = windows.row_numbers(rows, ["g"], order, "v")
    want = rows.withColumn("v", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long"))
    assert got.columns == want.columns and sorted(map(tuple, got.select("id", "v").collect())) == sorted(map(tuple, want.select("id", "v").collect()))
    assert kept[0].where("g = 'a'").select(F.shiftright("__at", 33)).distinct().count() > 1


def test_no_sketch_per_distinct_value(spark):
    plan = registry.QUERIES["approx_distinct_bound"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("approx_count_distinct(" in line and "count(distinct" in line for line in plan.splitlines())
