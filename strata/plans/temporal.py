"""Time series over events, vectors over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as vec
from ..operators import timeseries as ts
from ..operators import vectors as vs
from .base import Registry

R = Registry()
START, END = "2024-01-05 00:00:00", "2024-01-25 12:00:00"
SPAN = f"ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'"


@R.code("range_query", f"SELECT event_id, ts, value FROM events WHERE {SPAN} AND value BETWEEN 10 AND 60")
def _(t):
    return ts.in_range(t("events"), "ts", START, END, 10, 60).select("event_id", "ts", "value")


@R.code("range_query_desc", f"SELECT event_id, value FROM events WHERE {SPAN} ORDER BY ts DESC, event_id LIMIT 25")
def _(t):
    return ts.in_range(t("events"), "ts", START, END).orderBy(F.desc("ts"), "event_id").limit(25).select("event_id", "value")


_STATS = """count(value) AS n, round(sum(value), 3) AS sum, round(avg(value), 5) AS avg, min(value) AS min, max(value) AS max,
    arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, round(coalesce(stddev_samp(value), 0), 5) AS stddev"""


def _rounded(df):
    return df.select(*[F.round(c, d).alias(c) if (d := {"sum": 3, "avg": 5, "stddev": 5}.get(c)) else F.col(c) for c in df.columns])


@R.code("range_agg", f"SELECT {_STATS} FROM events WHERE {SPAN}")
def _(t):
    return _rounded(ts.in_range(t("events"), "ts", START, END).agg(*ts.stats(tie="event_id")))


@R.code("range_agg_empty", "SELECT count(value) AS n, sum(value) AS sum, CAST(NULL AS DOUBLE) AS stddev FROM events WHERE ts < TIMESTAMP '1999-01-01 00:00:00'")
def _(t):
    return ts.in_range(t("events"), "ts", "1998-01-01", "1999-01-01").agg(*ts.stats(tie="event_id")).select("n", "sum", "stddev")


@R.code("groupby_interval", f"""
    SELECT CAST(TIMESTAMP '{START}' + to_microseconds(CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{START}')) / 5400000000) * 5400000000 AS BIGINT)) AS TIMESTAMP) AS bucket, {_STATS}
    FROM events WHERE {SPAN} GROUP BY 1""")
def _(t):
    return _rounded(ts.group_by_interval(t("events"), START, END, 5400, tie="event_id"))


@R.code("downsample_spine", f"""
    WITH s AS (SELECT TIMESTAMP '{START}' + to_microseconds(CAST(k * 25200000000 AS BIGINT)) AS bucket
               FROM range(CAST(ceil((epoch_us(TIMESTAMP '{END}') - epoch_us(TIMESTAMP '{START}')) / 25200000000) AS BIGINT)) r(k)),
    e AS (SELECT TIMESTAMP '{START}' + to_microseconds(CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{START}')) / 25200000000) * 25200000000 AS BIGINT)) AS bucket, avg(value) AS a, count(value) AS n
          FROM events WHERE {SPAN} GROUP BY 1)
    SELECT s.bucket, least(s.bucket + INTERVAL 7 HOUR, TIMESTAMP '{END}') AS bucket_end, round(a, 5) AS avg, coalesce(n, 0) AS n FROM s LEFT JOIN e USING (bucket)""")
def _(t):
    return ts.downsample(t("events"), START, END, 25200).withColumn("avg", F.round("avg", 5))


@R.code("interval_buckets", "SELECT CAST(make_timestamp(CAST(floor((epoch_us(ts) / 1000000 + 62135596800) / 604800) * 604800 - 62135596800 AS BIGINT) * 1000000) AS TIMESTAMP) AS bucket, count(*) AS n, round(sum(value), 3) AS s FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy(ts.interval_bucket("ts", 7 * 86400).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("s"))


for _unit in ("day", "week", "month", "quarter", "year"):

    def _bucketed(t, unit=_unit):
        return t("events").groupBy(ts.date_bucket("ts", unit).alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))

    R.code(f"date_bucket_{_unit}", f"SELECT CAST(date_trunc('{_unit}', ts) AS TIMESTAMP) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")(_bucketed)


@R.code("bucket_id", "SELECT 'events_Hour_' || strftime(ts, '%Y%m%d%H') AS h, 'events_Week_' || strftime(date_trunc('week', ts), '%Y%m%d') AS w, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    return t("events").groupBy(ts.bucket_id("events", "ts", "hour").alias("h"), ts.bucket_id("events", "ts", "week").alias("w")).agg(F.count(F.lit(1)).alias("n"))


@R.code("weighted_avg", "SELECT event_type, round(sum(value * user_id) / sum(user_id), 5) AS w FROM events GROUP BY event_type")
def _(t):
    return t("events").groupBy("event_type").agg(F.round(ts.weighted_avg("value", "user_id"), 5).alias("w"))


@R.code("series_summary", "SELECT event_type, median(value) AS med, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    p = lambda x: F.round(ts.percentile_100("value", x), 6)
    return t("events").groupBy("event_type").agg(ts.percentile_100("value", 50).alias("med"), p(25).alias("q1"), p(75).alias("q3"), F.count(F.lit(1)).alias("n"))


@R.code("first_last", "SELECT user_id, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY user_id")
def _(t):
    return t("events").groupBy("user_id").agg(*ts.stats(tie="event_id")).select("user_id", "first", "last")


_AGE = "CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS INT)"


@R.code("retention_tier", f"SELECT CASE WHEN {_AGE} < 7 THEN 'hot' WHEN {_AGE} < 30 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS n FROM events GROUP BY 1")
def _(t):
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    return t("events").groupBy(ts.PRESETS["standard"].tier(age).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


_HOURS = "date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-31 12:00:00') / 3600"


@R.code("retention_hours", f"SELECT CASE WHEN {_HOURS} < 1 THEN 'hot' WHEN {_HOURS} < 24 THEN 'warm' ELSE 'cold' END AS tier, count(*) AS n FROM events WHERE {_HOURS} < 168 GROUP BY 1")
def _(t):
    """Tiers of hours; what is older than the policy keeps is purged."""
    policy, age = ts.PRESETS["live"], ts.age_in_days(F.date_trunc("second", "ts"), F.lit("2024-01-31 12:00:00").cast("timestamp"))
    return policy.purge(t("events"), age).groupBy(policy.tier(age).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@R.code("policy_downsampling", f"""
    SELECT ts, value, CAST(1 AS BIGINT) AS n FROM events WHERE {_AGE} < 7
    UNION ALL SELECT CAST(make_timestamp(CAST(floor(epoch_us(ts) / 300000000) * 300000000 AS BIGINT)) AS TIMESTAMP), round(avg(value), 6), count(*) FROM events WHERE {_AGE} >= 7 AND {_AGE} < 30 GROUP BY 1
    UNION ALL SELECT CAST(make_timestamp(CAST(floor(epoch_us(ts) / 3600000000) * 3600000000 AS BIGINT)) AS TIMESTAMP), round(avg(value), 6), count(*) FROM events WHERE {_AGE} >= 30 GROUP BY 1""")
def _(t):
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    return ts.apply_downsampling(t("events"), ts.PRESETS["standard"], age).withColumn("value", F.round("value", 6))


@R.code("rollup_stats", "SELECT sum(n)::BIGINT AS points, count(*) AS buckets, round(sum(n) / count(*), 6) AS ratio FROM (SELECT floor(epoch_us(ts) / 3600000000) AS b, count(*) AS n FROM events GROUP BY 1)")
def _(t):
    return ts.rollup_stats(t("events"), "ts", 3600).withColumn("ratio", F.round("ratio", 6))


@R.code("as_of_join", """
    WITH p AS (SELECT user_id, ts, event_id AS purchase, value AS amount FROM events WHERE event_type = 'purchase'),
    best AS (SELECT user_id, ts, max(purchase) AS purchase FROM p GROUP BY 1, 2)
    SELECT e.event_id, b.purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN best b ON e.user_id = b.user_id AND e.ts >= b.ts""")
def _(t):
    bought = t("events").where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase"))
    return ts.as_of(t("events").where("event_type <> 'purchase'"), bought, ["user_id"]).select("event_id", "purchase")


# -- vectors
_V = "list_transform(a.embedding, lambda x: CAST(x AS DOUBLE))"
_Q = "list_transform(q.embedding, lambda x: CAST(x AS DOUBLE))"
_PAIRS = "FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) q"


def _with_query(t):
    q = F.broadcast(t("embeddings").where("vec_id = 3").select(F.col("embedding").alias("q")))
    return t("embeddings").crossJoin(q)  # one row: the primary key's


for _name, _fn, _sql in (
    ("vec_cosine", vec.cosine_distance, f"1 - list_cosine_similarity({_V}, {_Q})"),
    ("vec_l2", vec.l2_distance, f"list_distance({_V}, {_Q})"),
    ("vec_dot", vec.dot_distance, f"-list_dot_product({_V}, {_Q})"),
):

    def _measured(t, fn=_fn):
        return _with_query(t).select("vec_id", (F.round(fn(F.col("embedding"), F.col("q")), 6) + 0.0).alias("d"))

    R.code(_name, f"SELECT a.vec_id, round({_sql}, 6) + 0.0 AS d {_PAIRS}")(_measured)


@R.code("vec_normalize", f"SELECT a.vec_id, round(list_sum(list_transform({_V}, lambda x: x * x)) / list_sum(list_transform({_V}, lambda x: x * x)), 6) AS n, round(a.embedding[5] / sqrt(list_sum(list_transform({_V}, lambda x: x * x))), 6) + 0.0 AS x FROM embeddings a")
def _(t):
    unit = t("embeddings").select("vec_id", vec.normalize(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(vec.norm(F.col("u")), 6).alias("n"), (F.round(F.col("u")[4], 6) + 0.0).alias("x"))


@R.code("vec_json", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, true AS same FROM embeddings")
def _(t):
    e = F.col("embedding")
    back = vec.from_json(vec.to_json(e))
    return t("embeddings").select("vec_id", vec.dimensions(e).alias("n"), (back == e).alias("same"))


@R.code("knn_exact", f"""
    WITH p AS (SELECT q.vec_id AS query_id, a.vec_id AS id, list_distance({_V}, {_Q}) AS d
               FROM embeddings a, embeddings q WHERE q.vec_id % 20 = 0 AND a.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM p)
    SELECT query_id, id, round(d, 5) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def _(t):
    e = t("embeddings")
    return vs.knn(e, e.where("vec_id % 20 = 0"), 10).withColumn("distance", F.round("distance", 5))


@R.code("knn_ivf")
def _(t):
    e = t("embeddings")
    return vs.IvfIndex(e).search(e.where("vec_id % 20 = 0"), 10, probes=24)


@R.code("vec_order_limit", f"SELECT a.vec_id, round(1 - list_cosine_similarity({_V}, list_transform(range(64), lambda i: 1.0)), 6) AS distance FROM embeddings a ORDER BY 1 - list_cosine_similarity({_V}, list_transform(range(64), lambda i: 1.0)), a.vec_id LIMIT 12")
def _(t):
    return vs.top_k(t("embeddings"), [1.0] * 64, 12).select("vec_id", F.round("distance", 6).alias("distance"))


@R.code("quantize_scalar8", """
    WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    q AS (SELECT d, min(v) AS lo, CASE WHEN max(v) > min(v) THEN 255.0 / (max(v) - min(v)) ELSE 0 END AS scale FROM x GROUP BY d)
    SELECT vec_id, CAST(sum(least(greatest(floor((v - lo) * scale + 0.5), 0), 255)) AS BIGINT) AS total FROM x JOIN q USING (d) GROUP BY vec_id""")
def _(t):
    e = t("embeddings")
    coded = vs.quantize(e, vs.scalar_quantizer(e))
    return coded.select("vec_id", F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@R.code("quantize_binary_hamming", f"SELECT a.vec_id, CAST(list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END)) AS INT) AS h {_PAIRS}")
def _(t):
    return _with_query(t).select("vec_id", vs.hamming(vs.binary_code("embedding"), vs.binary_code("q")).alias("h"))
