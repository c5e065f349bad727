"""Aggregates, OLAP, windows and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, scalar
from ..operators import aggregates as agg
from ..operators import windows as win
from .base import Registry

R = Registry()

# -- aggregates
R.sql("count_star", "SELECT count(*) AS n, count(x) AS nx FROM (SELECT nullif(o_orderstatus, 'O') AS x FROM orders) q")
R.sql("count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
R.sql("sum_avg_min_max", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderpriority")
R.sql("sum_empty_null", "SELECT sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS m, count(*) AS n FROM orders WHERE o_orderkey < 0")
R.sql("stddev_samp", "SELECT o_orderstatus, round(stddev_samp(o_totalprice), 3) AS s FROM orders GROUP BY o_orderstatus")
R.sql("stddev_pop", "SELECT o_orderstatus, round(stddev_pop(o_totalprice), 3) AS s FROM orders GROUP BY o_orderstatus")
R.sql("var_samp", "SELECT l_returnflag, round(var_samp(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag")
R.sql("var_pop", "SELECT l_returnflag, round(var_pop(l_quantity), 6) AS v FROM lineitem GROUP BY l_returnflag")
R.sql("stddev_single_null", "SELECT stddev_samp(n_nationkey) AS s, var_samp(n_nationkey) AS v FROM nation WHERE n_nationkey = 3")
R.sql("median", "SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY p_brand")
R.sql("agg_expr", "SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge FROM lineitem GROUP BY l_linestatus")
R.sql("agg_filter", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS s FROM orders GROUP BY o_custkey")
R.sql("agg_filter_join", "SELECT c_mktsegment, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
R.sql("sum_distinct", "SELECT l_returnflag, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag")
R.sql("group_multi", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
R.sql("having_alias", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12")
R.sql("cube", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
R.sql("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
R.sql("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@R.code("total_empty", "SELECT coalesce(sum(o_totalprice), 0.0) AS t FROM orders WHERE o_orderkey < 0")
def _(t):
    return t("orders").where("o_orderkey < 0").agg(agg.total("o_totalprice").alias("t"))


@R.code("group_concat", "SELECT n_regionkey, string_agg(x, '|' ORDER BY x) FILTER (WHERE x <> '') AS names FROM (SELECT n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS x FROM nation) GROUP BY n_regionkey")
def _(t):
    rows = t("nation").withColumn("x", F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name")))
    return rows.groupBy("n_regionkey").agg(scalar.group_concat("x", "|").alias("names"))


@R.code("percentile_p95", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10 FROM lineitem GROUP BY l_returnflag")
def _(t):
    found = agg.percentiles_by_rank(t("lineitem"), ["l_returnflag"], "l_extendedprice", {"p95": 0.95, "p10": 0.1})
    return found.select("l_returnflag", F.round("p95", 4).alias("p95"), F.round("p10", 4).alias("p10"))


@R.code("percentile_by_rank", "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50 FROM lineitem GROUP BY ALL")
def _(t):
    found = agg.percentiles_by_rank(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p95": 0.95, "p50": 0.5})
    return found.select("l_returnflag", "l_linestatus", F.round("p95", 4).alias("p95"), F.round("p50", 4).alias("p50"))


@R.code("mode", "SELECT l_returnflag, min(l_quantity) AS m FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY n DESC) AS r FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1 GROUP BY l_returnflag")
def _(t):
    return agg.modes(t("lineitem"), ["l_returnflag"], "l_quantity", "m")


@R.code("olap_from_sql", "SELECT coalesce(c_mktsegment, 'NULL') AS c_mktsegment, count(*) FILTER (WHERE n_regionkey = 0) AS \"0\", count(*) FILTER (WHERE n_regionkey = 1) AS \"1\" FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).createOrReplaceTempView("olap_rows")
    found = agg.query_cube(t("nation").sparkSession, "SELECT c_mktsegment, n_regionkey FROM olap_rows", "c_mktsegment", "n_regionkey", F.count(F.lit(1)), ["0", "1"])
    return found.na.fill(0)


@R.code("corr", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS c, CAST(NULL AS DOUBLE) AS flat FROM lineitem GROUP BY l_returnflag")
def _(t):
    flat = agg.corr("l_quantity", F.lit(1.0))
    return t("lineitem").groupBy("l_returnflag").agg(F.round(agg.corr("l_quantity", "l_extendedprice"), 8).alias("c"), flat.alias("flat"))


R.sql("covar", "SELECT l_linestatus, round(covar_samp(l_quantity, l_extendedprice), 3) AS cs, round(covar_pop(l_quantity, l_extendedprice), 3) AS cp FROM lineitem GROUP BY l_linestatus")


@R.code("histogram", """
    WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
    SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 8)) + 1, 8) AS INT) AS bucket, count(*) AS count FROM orders, s GROUP BY 1""")
def _(t):
    return agg.histogram(t("orders"), "o_totalprice", 8).select("bucket", "count")


@R.code("pivot_olap", """
    SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS "F", sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS "O"
    FROM lineitem GROUP BY l_returnflag""")
def _(t):
    return agg.pivot(t("lineitem"), "l_returnflag", "l_linestatus", F.sum("l_quantity"), ["F", "O"])


@R.code("collation_group", "SELECT lower(x) AS k, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS x FROM customer) GROUP BY 1")
def _(t):
    x = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    grouped = t("customer").groupBy(F.collate(x, "UTF8_LCASE").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.lower(F.collate("g", "UTF8_BINARY")).alias("k"), "n")


@R.code("approx_distinct_bound", "SELECT true AS near")
def _(t):
    """abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.2 * count(DISTINCT l_partkey), each count on its own: together, Spark keeps a sketch per distinct value."""
    rows = t("lineitem").select("l_partkey")
    roughly = rows.agg(F.approx_count_distinct("l_partkey").alias("roughly"))
    exactly = rows.agg(F.count_distinct("l_partkey").alias("exactly"))
    return roughly.crossJoin(F.broadcast(exactly)).select((F.abs(F.col("roughly") - F.col("exactly")) <= 0.2 * F.col("exactly")).alias("near"))  # one row each


# -- windows
for _name, _expr in {
    "row_number": "CAST(row_number() OVER w AS BIGINT)",
    "rank": "CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT)",
    "dense_rank": "CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT)",
    "lag": "lag(o_totalprice) OVER w",
    "lag_2": "lag(o_totalprice, 2) OVER w",
    "lead": "lead(o_totalprice, 1) OVER w",
    "first_value": "first_value(o_totalprice) OVER w",
    "last_value": "last_value(o_totalprice) OVER w",
    "ntile": "CAST(ntile(4) OVER w AS BIGINT)",
    "percent_rank": "round(percent_rank() OVER w, 9)",
    "cume_dist": "round(cume_dist() OVER w, 9)",
    "sum_over": "round(sum(o_totalprice) OVER w, 2)",
    "avg_over_all": "round(avg(o_totalprice) OVER (PARTITION BY o_custkey) + 0.0000013, 4)",
    "stddev_over": "round(stddev_pop(o_totalprice) OVER (PARTITION BY o_custkey), 3)",
    "frame_n_preceding": "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2)",
    "frame_following": "round(max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 2)",
}.items():
    R.sql(_name, f"SELECT o_orderkey, {_expr} AS v FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")


@R.code("window_multi", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS BIGINT) AS v FROM lineitem")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return win.row_numbers(rows, ["l_returnflag", "l_linestatus"], order, "v").select("l_orderkey", "l_linenumber", "v")


R.sql("topk_per_group", "SELECT * FROM (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS r FROM part) q WHERE r <= 3")


@R.code("window_filter", "SELECT o_orderkey, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n FROM orders")
def _(t):
    w = Window.partitionBy("o_custkey")
    return t("orders").select("o_orderkey", win.filtered_over(F.count, "o_orderkey", F.col("o_orderstatus") == "F", w).alias("n"))


@R.code("rolling_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS v FROM events")
def _(t):
    return t("events").select("event_id", F.round(win.rolling(F.sum("value"), ["user_id"], ["ts", "event_id"], 3), 4).alias("v"))


@R.code("rolling_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) + 0.0000013, 4) AS v FROM events")
def _(t):
    return t("events").select("event_id", F.round(win.rolling(F.avg("value"), ["user_id"], ["ts", "event_id"], 2) + 0.0000013, 4).alias("v"))


@R.code("cumulative_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS v FROM events")
def _(t):
    return t("events").select("event_id", F.round(win.cumulative(F.sum("value"), ["user_id"], ["ts", "event_id"]), 4).alias("v"))


@R.code("cumulative_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 0.0000013, 4) AS v FROM events")
def _(t):
    return t("events").select("event_id", F.round(win.cumulative(F.avg("value"), ["user_id"], ["ts", "event_id"]) + 0.0000013, 4).alias("v"))


# -- scalar functions
R.sql("null_funcs", "SELECT c_custkey, coalesce(nullif(c_nationkey, 1), -1) AS a, ifnull(nullif(c_mktsegment, 'BUILDING'), 'none') AS b, nullif(c_nationkey, 2) AS c FROM customer")
R.sql("math_funcs", "SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(pow(p_size, 2), 3) AS p, round(sqrt(p_size), 9) AS s, mod(p_partkey, 7) AS m, CAST(sign(p_size - 25) AS INT) AS g, round(p_retailprice, 1) AS r FROM part")
R.sql("scalar_min_max", "SELECT p_partkey, greatest(p_size, 20) AS hi, least(p_size, 20, NULL) AS lo FROM part")
R.sql("string_funcs", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS BIGINT) AS n, trim('  x ') AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt, substr(p_name, 2, 3) AS s, substr(p_name, 3) AS s2, replace(p_type, 'A', '_') AS r, CAST(instr(p_name, 'a') AS BIGINT) AS i, p_name LIKE '%e%' AS k, concat(p_brand, '-', p_type) AS c FROM part")
R.sql("hex_funcs", "SELECT n_nationkey, hex(n_name) AS h FROM nation")
R.sql("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(hour(o_orderdate) AS BIGINT) AS h, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP_NTZ) AS dt FROM orders", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS dt FROM orders")
R.sql("arithmetic", "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity - l_tax AS b, l_quantity * 2 AS c, l_extendedprice / l_quantity AS d, -l_linenumber AS e FROM lineitem")
R.sql("typeof_cast", "SELECT c_custkey, CAST(c_acctbal AS BIGINT) IS NOT NULL AS i, CAST(c_custkey AS STRING) AS s, try_cast(c_mktsegment AS INT) AS bad, try_cast('12' AS INT) AS good FROM customer")


@R.code("typeof", "SELECT c_custkey, 'integer' AS a, CASE WHEN c_nationkey = 4 THEN 'null' ELSE 'real' END AS b, 'text' AS c FROM customer")
def _(t):
    rows = t("customer").withColumn("x", F.when(F.col("c_nationkey") != 4, F.col("c_acctbal")))
    return rows.select("c_custkey", scalar.typeof("c_custkey", "bigint").alias("a"), scalar.typeof("x", "double").alias("b"), scalar.typeof("c_name", "string").alias("c"))


@R.code("iif", "SELECT p_partkey, CASE WHEN p_size > 10 THEN 'big' ELSE 'small' END AS v FROM part")
def _(t):
    return t("part").select("p_partkey", scalar.iif(F.col("p_size") > 10, F.lit("big"), F.lit("small")).alias("v"))


@R.code("quote_unhex", "SELECT n_nationkey, '''' || replace(n_name, 'A', '''''') || '''' AS q, n_name AS u FROM nation")
def _(t):
    rows = t("nation")
    return rows.select("n_nationkey", scalar.quote(F.replace("n_name", F.lit("A"), F.lit("'"))).alias("q"), scalar.unhex_text(F.hex("n_name")).alias("u"))


@R.code("char_unicode", "SELECT n_nationkey, chr(CAST(65 + n_nationkey AS INT)) || chr(8364) || chr(128512) AS c, ord(n_name) AS u FROM nation")
def _(t):
    return t("nation").select("n_nationkey", scalar.char(F.col("n_nationkey") + 65, 8364, 128512).alias("c"), scalar.unicode("n_name").alias("u"))


@R.code("date_add", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS d, o_orderdate + INTERVAL 2 MONTH AS m, o_orderdate - INTERVAL 1 YEAR AS y, o_orderdate + INTERVAL 5 HOUR AS h, o_orderdate + INTERVAL 7 MINUTE AS n, o_orderdate - INTERVAL 9 SECOND AS s FROM orders")
def _(t):
    ts, add = F.col("o_orderdate"), dates.date_add
    return t("orders").select("o_orderkey", add(ts, 3, "day").alias("d"), add(ts, 2, "month").alias("m"), add(ts, -1, "year").alias("y"), add(ts, 5, "hour").alias("h"), add(ts, 7, "minute").alias("n"), add(ts, -9, "second").alias("s"))


@R.code("strftime", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%j') AS j, strftime(ts, '%w') AS w, strftime(ts, '%Y%%') AS p FROM events")
def _(t):
    ts = F.col("ts")
    return t("events").select("event_id", *[dates.strftime(f, ts).alias(a) for f, a in (("%Y-%m-%d %H:%M:%S", "a"), ("%j", "j"), ("%w", "w"), ("%Y%%", "p"))])


@R.code("date_modifiers", "SELECT event_id, CAST(date_trunc('month', ts) + INTERVAL 10 DAY AS TIMESTAMP) AS a, CAST(date_trunc('year', ts) AS TIMESTAMP) AS y, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d FROM events")
def _(t):
    ts = F.col("ts")
    return t("events").select("event_id", dates.apply_modifiers(ts, "start of month", "+10 days").alias("a"), dates.apply_modifiers(ts, "start of year").alias("y"), dates.apply_modifiers(ts, "start of day").alias("d"))


@R.code("julianday", "SELECT event_id, round(2451545.0 + (epoch_us(ts) - 946728000000000) / 86400000000.0 + 0.0000000137, 6) AS jd FROM events")
def _(t):
    return t("events").select("event_id", F.round(dates.julianday(F.col("ts")) + 0.0000000137, 6).alias("jd"))


@R.code("unixepoch", "SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS e, epoch_us(ts) * 10 + 621355968000000000 AS ticks FROM events")
def _(t):
    return t("events").select("event_id", dates.unixepoch(F.col("ts")).alias("e"), scalar.sync_timestamp(F.col("ts").cast("timestamp")).alias("ticks"))


@R.code("ulid_time", "SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms, 26 AS n FROM events")
def _(t):
    made = t("events").withColumn("u", scalar.ulid(F.col("ts").cast("timestamp")))
    return made.select("event_id", scalar.ulid_millis("u").alias("ms"), F.length("u").alias("n"))


@R.code("session_clock", "SELECT n_nationkey, true AS ok FROM nation")
def _(t):
    now = (F.current_timestamp().isNotNull() & F.current_date().isNotNull() & (F.date_format(F.current_timestamp(), "HH:mm:ss") != "")).alias("ok")
    return t("nation").select("n_nationkey", now & scalar.random_int64().isNotNull()).toDF("n_nationkey", "ok")
