"""DML as transforms, events and streams, sharding, user functions, change tracking."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

from ..functions.udf import Functions, MergeableAggregate, TypeProvider
from ..operators import dml, events, sharding
from ..scratch import materialize
from ..sources import tables
from ..streaming import streams
from .base import Registry

R = Registry()


def _incoming(t):
    """Customers with even keys, balance up by one, and as many new ones."""
    old = t("customer").where("c_custkey % 2 = 0").withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 2))
    return old.union(old.withColumn("c_custkey", F.col("c_custkey") + 1_000_000))


_IN = """i AS (SELECT c_custkey, c_name, c_nationkey, round(c_acctbal + 1, 2) AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, round(c_acctbal + 1, 2), c_mktsegment FROM customer WHERE c_custkey % 2 = 0)"""


@R.code("insert_select", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region")
def _(t):
    rows = t("region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return dml.insert(t("nation"), rows)


@R.code("default_fill", "SELECT r_regionkey AS n_nationkey, r_name AS n_name, 7 AS n_regionkey FROM region")
def _(t):
    rows = t("region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return dml.with_defaults(rows, t("nation"), {"n_regionkey": 7})


@R.code("upsert_do_nothing", f"WITH {_IN} SELECT * FROM customer UNION ALL SELECT * FROM i WHERE c_custkey >= 1000000")
def _(t):
    return dml.do_nothing(t("customer"), _incoming(t), ["c_custkey"])


@R.code("upsert_do_update", f"WITH {_IN} SELECT c.c_custkey, c.c_name, c.c_nationkey, CASE WHEN i.c_custkey IS NOT NULL AND c.c_acctbal > 0 THEN round(c.c_acctbal + i.c_acctbal, 2) ELSE c.c_acctbal END AS c_acctbal, c.c_mktsegment FROM customer c LEFT JOIN i USING (c_custkey) UNION ALL SELECT * FROM i WHERE c_custkey >= 1000000")
def _(t):
    return dml.upsert(t("customer"), _incoming(t), ["c_custkey"], {"c_acctbal": "round(target.c_acctbal + excluded.c_acctbal, 2)"}, "target.c_acctbal > 0")


@R.code("insert_or_replace", f"WITH {_IN} SELECT * FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT * FROM i")
def _(t):
    return dml.insert_or_replace(t("customer"), _incoming(t), ["c_custkey"])


@R.code("insert_or_abort", f"WITH {_IN} SELECT c_custkey FROM i WHERE c_custkey < 1000000")
def _(t):
    return dml.conflicts(t("customer"), _incoming(t), ["c_custkey"]).select("c_custkey")


@R.code("update_where", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN round(o_totalprice * 0.9 + 0.000001, 2) ELSE o_totalprice END AS o_totalprice FROM orders")
def _(t):
    return dml.update(t("orders"), {"o_totalprice": "round(o_totalprice * 0.9 + 0.000001, 2)"}, "o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")


@R.code("delete_where", "SELECT * FROM part WHERE NOT (p_size > 25)")
def _(t):
    return dml.delete(t("part"), "p_size > 25")


@R.code("update_returning", "SELECT s_suppkey, round(s_acctbal * 2, 2) AS s_acctbal FROM supplier WHERE s_acctbal < 0")
def _(t):
    return dml.returning_updated(t("supplier"), {"s_acctbal": "round(s_acctbal * 2, 2)"}, "s_acctbal < 0", "s_suppkey", "s_acctbal")


@R.code("delete_returning", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 4")
def _(t):
    return dml.returning_deleted(t("supplier"), "s_nationkey = 4", "s_suppkey", "s_name")


@R.code("check_violations", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0)")
def _(t):
    return dml.check_violations(t("customer"), "c_acctbal > 0").select("c_custkey")


@R.code("foreign_key_check", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def _(t):
    return dml.foreign_key_violations(t("orders"), "o_custkey", t("customer"), "c_custkey").select("o_orderkey")


@R.code("snapshot_read", "SELECT count(*) AS before, count(*) FILTER (WHERE n_regionkey <> 2) AS after FROM nation")
def _(t):
    nation = t("nation")
    from ..scratch import scratch_path

    table = dml.VersionedTable(nation.sparkSession, scratch_path(nation.sparkSession, "versions"))
    first = table.commit(nation)
    table.commit(dml.delete(table.read(), "n_regionkey = 2"))
    old, new = table.read(first).agg(F.count(F.lit(1)).alias("before")), table.read().agg(F.count(F.lit(1)).alias("after"))
    return old.crossJoin(new)  # one row each


@R.code("change_tracking", f"WITH {_IN} SELECT c_custkey, CASE WHEN c_custkey >= 1000000 THEN 'insert' WHEN c_custkey % 2 = 0 THEN 'update' ELSE 'delete' END AS operation, c_custkey % 2 = 1 AND c_custkey < 1000000 AS tombstone FROM (SELECT c_custkey FROM customer UNION SELECT c_custkey FROM i)")
def _(t):
    return tables.changes(t("customer"), _incoming(t), ["c_custkey"])


# -- events
def event_log(t):
    new = t("events").select(F.col("user_id").alias("stream_id"), "event_id", "event_type", "value", "ts")
    empty = new.where("false").select("stream_id", F.lit(0).cast("long").alias("stream_sequence"), F.lit(0).cast("long").alias("global_sequence"), "event_id", "event_type", "value", "ts")
    return events.append(empty, new, ["ts", "event_id"])


_LOG = """l AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stream_sequence,
    row_number() OVER (ORDER BY ts, event_id) AS global_sequence, event_id, event_type, value, ts FROM events)"""


@R.code("event_append", f"WITH {_LOG} SELECT stream_id, stream_sequence, global_sequence, event_id FROM l")
def _(t):
    return event_log(t).select("stream_id", "stream_sequence", "global_sequence", "event_id")


@R.code("stream_range", f"WITH {_LOG} SELECT stream_sequence, event_id FROM l WHERE stream_id = 7 AND stream_sequence BETWEEN 2 AND 9")
def _(t):
    return events.read_stream(event_log(t), 7, 2, 9).select("stream_sequence", "event_id")


@R.code("read_all_limit", f"WITH {_LOG} SELECT global_sequence, event_id FROM l WHERE global_sequence > 100 ORDER BY global_sequence LIMIT 50")
def _(t):
    return events.read_all(event_log(t), 100, 50).select("global_sequence", "event_id")


@R.code("latest_snapshot", f"WITH {_LOG}, s AS (SELECT stream_id, stream_sequence AS version, round(sum(value) OVER (PARTITION BY stream_id ORDER BY stream_sequence), 4) AS state FROM l) SELECT stream_id, max(version) AS version, arg_max(state, version) AS state FROM s WHERE version % 5 = 0 GROUP BY stream_id")
def _(t):
    return events.latest_snapshot(_snapshots(t)).withColumn("state", F.round("state", 4))


def _snapshots(t):
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id").orderBy("stream_sequence").rowsBetween(Window.unboundedPreceding, 0)
    states = event_log(t).select("stream_id", F.col("stream_sequence").alias("version"), F.sum("value").over(w).alias("state"))
    return states.where(events.snapshot_due(F.col("version"), 5))


@R.code("load_with_snapshot", f"WITH {_LOG} SELECT stream_id, max(stream_sequence) AS length, max(stream_sequence) % 5 AS tail, round(sum(value), 3) AS state FROM l GROUP BY stream_id")
def _(t):
    return events.load_with_snapshot(event_log(t), _snapshots(t)).withColumn("state", F.round("state", 3))


@R.code("rehydrate", "SELECT user_id AS stream_id, round(sum(value), 3) AS state FROM events GROUP BY user_id")
def _(t):
    return events.rehydrate(event_log(t), lambda s, v: s + v, F.lit(0.0)).withColumn("state", F.round("state", 3))


@R.code("upcast", "SELECT event_type || '.v2' AS event_type, count(*) AS n, round(sum(value * 100), 1) AS cents FROM events GROUP BY 1")
def _(t):
    rename = lambda df: df.withColumn("event_type", F.concat("event_type", F.lit(".v2")))
    rescale = lambda df: df.withColumn("value", F.col("value") * 100)
    return events.upcast(t("events"), rename, rescale).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 1).alias("cents"))


@R.code("projection_lag", "SELECT count(*) AS head, CAST(10 AS BIGINT) AS checkpoint, count(*) - 10 AS lag FROM events")
def _(t):
    return events.projection_lag(event_log(t), 10)


@R.code("outbox", "SELECT event_id AS message_id, CASE WHEN event_id % 3 = 0 THEN 'published' WHEN event_id % 3 = 1 AND event_id % 5 >= 4 THEN 'dead' ELSE 'pending' END AS status, CAST(event_id % 5 + CASE WHEN event_id % 3 < 2 THEN 1 ELSE 0 END AS INT) AS attempts FROM events")
def _(t):
    e = t("events")
    box = e.select(F.col("event_id").alias("message_id"), F.lit("pending").alias("status"), (F.col("event_id") % 5).cast("int").alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.col("ts").cast("timestamp").alias("next_attempt"))
    results = e.where("event_id % 3 < 2").select(F.col("event_id").alias("message_id"), (F.col("event_id") % 3 == 0).alias("ok"), F.lit(None).cast("string").alias("error"))
    return events.Outbox(5).settle(box, results, F.current_timestamp()).select("message_id", "status", "attempts")


# -- streams
def _stream(name, oracle, build):
    def run(spark, sf_dir):
        return build(spark, streams.file_stream(spark, sf_dir, "events", "ts"))

    R._add(name, run, oracle)


_stream("stream_tumbling", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 3) AS s FROM events GROUP BY 1, 2",
        lambda spark, e: streams.run_available(streams.tumbling(e, "ts", "1 day", "1 hour", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("s")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "s"), "complete"))
_stream("stream_sliding", "SELECT CAST(date_trunc('hour', ts) - to_hours(k) AS TIMESTAMP) AS start, count(*) AS n FROM events, range(2) r(k) GROUP BY 1",
        lambda spark, e: streams.run_available(streams.sliding(e, "ts", "2 hours", "1 hour", "1 hour").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), "complete"))
_stream("stream_session", """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
        lambda spark, e: streams.run_available(streams.sessions(e, "ts", "30 minutes", "1 hour", "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n"), "complete"))
_stream("stream_dedup", "SELECT user_id, count(DISTINCT event_id) AS n FROM events GROUP BY user_id",
        lambda spark, e: streams.run_available(streams.deduplicated(e, "ts", "1 day", "event_id")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))


def _projection(spark, e):
    from ..scratch import scratch_path

    out = scratch_path(spark, "projection")
    streams.Projection("totals", lambda b, i: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("append").parquet(out), scratch_path(spark, "projection-state")).run(e)
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"))


_stream("projection_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type", _projection)


# -- distribution and user functions
@R.code("hash_shard")
def _(t):
    return t("customer").groupBy(sharding.hash_shard(F.col("c_custkey"), 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@R.code("composite_shard")
def _(t):
    return t("lineitem").groupBy(sharding.composite_shard([F.col("l_orderkey"), F.col("l_linenumber")], 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@R.code("range_shard", "SELECT CASE WHEN o_totalprice <= 50000 THEN 0 WHEN o_totalprice <= 150000 THEN 1 ELSE 2 END AS shard, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy(sharding.range_shard(F.col("o_totalprice"), [50000, 150000, 300000]).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@R.code("list_shard", "SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS shard, count(*) AS n FROM customer GROUP BY 1")
def _(t):
    return t("customer").groupBy(sharding.list_shard(F.col("c_mktsegment"), {"BUILDING": 1, "MACHINERY": 2}).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@R.code("shard_routed", "SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 AND o_totalprice <= 150000")
def _(t):
    from ..scratch import scratch_path

    orders = t("orders")
    path = scratch_path(orders.sparkSession, "sharded")
    sharding.write_sharded(orders, sharding.range_shard(F.col("o_totalprice"), [50000, 150000, 300000]), path)
    (one,) = sharding.route({"shard_of": 100000}, "shard_of", 3, lambda v: 0 if v <= 50000 else 1 if v <= 150000 else 2)
    return orders.sparkSession.read.parquet(path).where(F.col("shard") == one).select("o_orderkey")


@R.code("archived_scan", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-13 00:00:00'")
def _(t):
    from ..operators.timeseries import bucket_id
    from ..scratch import scratch_path

    e = t("events")
    path = scratch_path(e.sparkSession, "archive")
    tables.archive(e, path, bucket_id("events", "ts", "day"))
    return tables.read_archived(e.sparkSession, path, "events_Day_20240110", "events_Day_20240112").select("event_id")


@R.code("migrated_scan", "SELECT count(*) AS n, sum(p_size)::BIGINT AS s FROM part")
def _(t):
    from ..scratch import scratch_path

    part = t("part")
    first, second = scratch_path(part.sparkSession, "old"), scratch_path(part.sparkSession, "new")
    tables.append(part, first)
    tables.migrate(part.sparkSession, first, second, "orc")
    return part.sparkSession.read.orc(second).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("s"))


@R.code("conflict_lww", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(t):
    return sharding.lww(t("events"), ["user_id"], "event_type", "ts", "event_id")


@R.code("conflict_fww", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def _(t):
    return sharding.fww(t("events"), ["user_id"], "event_type", "ts", "event_id")


@R.code("conflict_merge", "SELECT user_id, max(event_type) AS event_type FROM events GROUP BY user_id")
def _(t):
    return sharding.resolve(t("events"), ["user_id"], "event_type", "ts", "event_id", "merge", merge=F.max("event_type"))


@R.code("conflict_custom", "SELECT user_id, list_extract(list(event_type ORDER BY ts, event_id), CAST(least(2, count(*)) AS INT)) AS event_type FROM events GROUP BY user_id")
def _(t):
    """The second write wins, or the only one."""
    return sharding.resolve(t("events"), ["user_id"], "event_type", "ts", "event_id", "custom", choose=lambda v: F.element_at(v, F.least(F.lit(2), F.size(v)))["value"])


@R.code("conflict_manual", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS choices FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def _(t):
    found = sharding.resolve(t("events"), ["user_id"], "event_type", "ts", "event_id", "manual")
    return found.select("user_id", F.array_join("values", ",").alias("choices"))


@R.code("archive_cycle", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS wrong, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00') AS restored, count(*) FILTER (WHERE NOT (ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00')) AS left_over FROM events")
def _(t):
    """Archive, verify, restore two days elsewhere, purge them from the archive."""
    from ..operators.timeseries import bucket_id
    from ..scratch import scratch_path

    e = t("events")
    spark, bucket, path, back = e.sparkSession, bucket_id("events", "ts", "day"), scratch_path(e.sparkSession, "archive"), scratch_path(e.sparkSession, "restored")
    tables.archive(e, path, bucket)
    wrong = tables.verify_archive(e, bucket, path).count()
    restored = tables.restore_archive(spark, path, "events_Day_20240110", "events_Day_20240111", back)
    tables.purge_archive(spark, path, "events_Day_20240110", "events_Day_20240111")
    left = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("left_over"))
    return e.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(wrong).cast("long").alias("wrong"), F.lit(restored).cast("long").alias("restored")).crossJoin(left)  # one row


@R.code("hash_index_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (7, 11)")
def _(t):
    """A bucketed table answers a lookup by its key from the buckets of the keys."""
    import uuid

    spark, name = t("orders").sparkSession, f"by_customer_{uuid.uuid4().hex}"
    tables.bucketed(t("orders"), name, "o_custkey", 8)
    found = materialize(spark.table(name).where(F.col("o_custkey").isin(7, 11)).select("o_orderkey", "o_totalprice"), "lookup")
    spark.sql(f"DROP TABLE {name}")
    return found


@R.code("index_hints", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def _(t):
    """Lookups steered to a copy sorted by the customer, and away from one sorted by the price."""
    from ..scratch import scratch_path

    orders = t("orders")
    hints = tables.Layouts(orders)
    for name, key in (("by_customer", "o_custkey"), ("by_price", "o_totalprice")):
        hints.add(name, key, scratch_path(orders.sparkSession, name))
    first = hints.prefer("by_customer").scan("o_custkey").where("o_custkey = 7").select("o_orderkey")
    return first.union(hints.avoid("by_price").scan("o_totalprice").where("o_totalprice > 200000").select("o_orderkey"))


@R.code("read_page", "SELECT event_id, count(*) OVER () AS total FROM events ORDER BY event_id LIMIT 20")
def _(t):
    log = t("events").withColumn("global_sequence", F.col("event_id"))
    return events.read_page(log, -1, 20).select("event_id", "total")


@R.code("vector_clocks", "SELECT n_nationkey, greatest(n_nationkey, 3) AS a, n_regionkey + 1 AS b, n_nationkey > 3 AND n_regionkey = 0 AS later FROM nation")
def _(t):
    mine = F.create_map(F.lit("a"), F.col("n_nationkey"), F.lit("b"), F.col("n_regionkey"))
    base = F.create_map(F.lit("a"), F.lit(3))
    merged = sharding.clock_increment(sharding.clock_merge(mine, base), "b")
    later = sharding.happened_before(base, mine) & (F.col("n_regionkey") == 0)
    return t("nation").select("n_nationkey", merged["a"].alias("a"), merged["b"].alias("b"), later.alias("later"))


@R.code("pandas_udf", "SELECT p_partkey, round(p_retailprice * 1.21, 4) AS gross FROM part")
def _(t):
    def gross(x: pd.Series) -> pd.Series:
        return x * 1.21

    fn = Functions(t("part").sparkSession).scalar("gross", gross, "double")
    return t("part").select("p_partkey", F.round(fn("p_retailprice"), 4).alias("gross"))


_SPREAD = MergeableAggregate(
    "lo double, hi double",
    lambda groups: pd.DataFrame({"lo": groups.min(), "hi": groups.max()}),
    lambda groups: pd.DataFrame({"lo": groups["lo"].min(), "hi": groups["hi"].max()}),
    lambda states: states["hi"] - states["lo"],
    "double",
)


@R.code("udaf", "SELECT l_returnflag, round(max(l_quantity) - min(l_quantity), 4) AS spread FROM lineitem GROUP BY l_returnflag")
def _(t):
    return _SPREAD.by(t("lineitem"), ["l_returnflag"], "l_quantity", "spread").withColumn("spread", F.round("spread", 4))


@R.code("window_udf", "SELECT l_orderkey, l_linenumber, round(max(l_quantity) OVER w - min(l_quantity) OVER w, 4) AS spread FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return _SPREAD.over(rows, ["l_orderkey"], "l_quantity", "spread").select("l_orderkey", "l_linenumber", F.round("spread", 4).alias("spread"))


@R.code("custom_type", "SELECT n_nationkey, CAST(n_regionkey AS DOUBLE) AS re, CAST(n_nationkey AS DOUBLE) AS im FROM nation")
def _(t):
    """Complex numbers kept as 16 bytes, written and read back through the type's provider."""
    nation = t("nation")
    complex_number = TypeProvider("complex", "binary", "struct<re:double,im:double>", lambda c: struct.pack("<dd", c["re"], c["im"]), lambda b: dict(zip(("re", "im"), struct.unpack("<dd", b), strict=True)))
    value = F.struct(F.col("n_regionkey").cast("double").alias("re"), F.col("n_nationkey").cast("double").alias("im"))
    stored = materialize(nation.select("n_nationkey", complex_number.store(value).alias("c")), "typed")
    return stored.withColumn("c", complex_number.load(F.col("c"))).select("n_nationkey", "c.re", "c.im")


@R.code("udtf", "SELECT n_nationkey, CAST(unnest(range(n_regionkey + 1)) AS INT) AS k FROM nation")
def _(t):
    class Count:
        def eval(self, n: int):
            for i in range(n + 1):
                yield (i,)

    nation = t("nation")
    Functions(nation.sparkSession).table("count_up", Count, "k int")
    nation.createOrReplaceTempView("udtf_nation")
    return nation.sparkSession.sql("SELECT n_nationkey, k FROM udtf_nation, LATERAL count_up(n_regionkey)")
