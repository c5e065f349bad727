"""Queries written in the embedded dialect."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dialect import Database
from ..operators import graph
from .base import Registry

R = Registry()


def _nearest_to_ones(spark):
    """A provider that turns every question into the vector of ones."""

    def answer(table, question, limit, top_k, min_score):
        nodes = spark.table(table).selectExpr("vec_id AS node_id", "embedding")
        found = graph.graph_rag(nodes, [1.0] * 64, limit, min_score, top_k)
        return found.withColumn("score", F.round("score", 6))

    return answer


def _dialect(name: str, sql: str, duck: str, tables: tuple[str, ...], params: dict | list | None = None, fields: list[str] | None = None) -> None:
    """fields: expressions over the result, where that holds structs."""

    def run(spark, sf_dir):
        for t in tables:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        db = Database(spark)
        db.provide("rag", _nearest_to_ones(spark))
        found = db.query(sql, params)
        return found.selectExpr(*fields) if fields else found

    R._add(name, run, duck)


_dialect("sql_some_none", "SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders) WHERE s IS NOT NONE AND o_orderkey IS SOME", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'", ("orders",))
_dialect("sql_glob_regexp", "SELECT c_custkey FROM customer WHERE c_name GLOB '*[1-3]?' AND c_mktsegment REGEXP '^[A-F]' AND c_name NOT GLOB '*5*'", "SELECT c_custkey FROM customer WHERE c_name GLOB '*[1-3]?' AND regexp_matches(c_mktsegment, '^[A-F]') AND c_name NOT LIKE '%5%'", ("customer",))
_dialect("sql_iif_total", "SELECT IIF(o_totalprice > 100000, 'big', 'small') AS k, TOTAL(o_totalprice) > 0 AS t, COUNT(*) AS n FROM orders GROUP BY 1", "SELECT CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS k, sum(o_totalprice) > 0 AS t, count(*) AS n FROM orders GROUP BY 1", ("orders",))
_dialect("sql_group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name, '; ') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", ("nation",))
_dialect("sql_percentiles", "SELECT l_returnflag, ROUND(PERCENTILE_95(l_quantity), 4) AS p, MEDIAN(l_quantity) AS m FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.95), 4) AS p, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag", ("lineitem",))
_dialect("sql_window_filter", "SELECT o_orderkey, SUM(o_orderkey) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS s FROM orders", "SELECT o_orderkey, CAST(sum(o_orderkey) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS BIGINT) AS s FROM orders", ("orders",))
_dialect("sql_strftime", "SELECT event_id, STRFTIME('%Y-%m-%d', ts, 'start of month', '+1 month', '-1 day') AS last_day, UNIXEPOCH(ts) AS u FROM events", "SELECT event_id, strftime(last_day(CAST(ts AS DATE)), '%Y-%m-%d') AS last_day, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS u FROM events", ("events",))
_dialect("sql_params_named", "SELECT o_orderkey FROM orders WHERE o_custkey = @who OR o_totalprice > @price", "SELECT o_orderkey FROM orders WHERE o_custkey = 3 OR o_totalprice > 250000", ("orders",), {"who": 3, "price": 250000})
_dialect("sql_params_positional", "SELECT c_custkey FROM customer WHERE c_nationkey = ? AND c_acctbal > ?", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 100", ("customer",), [3, 100])
_dialect("sql_limit_forms", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5", ("orders",))
_dialect("sql_collate", "SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment = 'building' COLLATE NOCASE", "SELECT count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'", ("customer",))
_dialect("sql_vec_distance", "SELECT a.vec_id, ROUND(VEC_DISTANCE_L2(a.embedding, b.embedding), 5) AS d FROM embeddings a CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 3) b", "SELECT a.vec_id, round(list_distance(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))), 5) AS d FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) b", ("embeddings",))
_dialect("sql_char_typeof", "SELECT n_nationkey, CHAR(65 + n_nationkey, 8364) AS c, TYPEOF(n_nationkey) AS k, TYPEOF(n_name) AS t, TYPEOF(1.5) AS r, TYPEOF(NULL) AS z FROM nation", "SELECT n_nationkey, chr(CAST(65 + n_nationkey AS INT)) || chr(8364) AS c, 'integer' AS k, 'text' AS t, 'real' AS r, 'null' AS z FROM nation", ("nation",))
_dialect("sql_datetime", "SELECT event_id, DATETIME(ts, '+1 day') AS d, STRFTIME(ts, 'yyyy/MM/dd HH') AS legacy FROM events", "SELECT event_id, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS d, strftime(ts, '%Y/%m/%d %H') AS legacy FROM events", ("events",))
_dialect("sql_ulid", "SELECT n_nationkey, LENGTH(ULID()) AS n, LENGTH(ULID_NEW()) AS m, SYNC_TIMESTAMP() > 638000000000000000 AS later FROM nation", "SELECT n_nationkey, 26 AS n, 26 AS m, true AS later FROM nation", ("nation",))
_dialect("sql_correlation", "SELECT l_returnflag, ROUND(CORRELATION(l_quantity, l_extendedprice), 6) AS c, CORRELATION(l_quantity, 1) AS z FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, CAST(NULL AS DOUBLE) AS z FROM lineitem GROUP BY l_returnflag", ("lineitem",))
_dialect("sql_vec_normalize", "SELECT vec_id, ROUND(ELEMENT_AT(VEC_NORMALIZE(embedding), 2), 6) AS x, VEC_DISTANCE_COSINE(embedding, NULL) AS z FROM embeddings", "SELECT vec_id, round(CAST(embedding[2] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS x, CAST(NULL AS DOUBLE) AS z FROM embeddings", ("embeddings",))
_dialect("sql_like_function", "SELECT c_custkey FROM customer WHERE LIKE(c_mktsegment, 'B%')", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'B%'", ("customer",))
_dialect("sql_unwrap", "SELECT o_orderkey, UNWRAP s AS status DEFAULT 'it''s open' FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders) WHERE MATCH SOME o_orderkey", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'it''s open' ELSE o_orderstatus END AS status FROM orders", ("orders",))
_dialect("sql_match_none", "SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders) WHERE MATCH NONE s", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'", ("orders",))
_dialect("sql_optionally", "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s OPTIONALLY FROM orders", "SELECT o_orderkey, o_orderstatus <> 'O' AS there, nullif(o_orderstatus, 'O') AS s FROM orders", ("orders",), fields=["o_orderkey.value AS o_orderkey", "s.is_some AS there", "s.value AS s"])
_dialect("sql_order_collate", "SELECT word, nth FROM (SELECT word, ROW_NUMBER() OVER (ORDER BY word COLLATE NOCASE, n) AS nth FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE lower(n_name) END AS word, n_nationkey AS n FROM nation))", "SELECT word, row_number() OVER (ORDER BY lower(word), n) AS nth FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE lower(n_name) END AS word, n_nationkey AS n FROM nation)", ("nation",))
_dialect("sql_recursive", "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 700) SELECT n FROM c", "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 700) SELECT n FROM c", ())
_dialect("sql_graph_traverse", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (GRAPH_TRAVERSE(orders, 900, 'o_custkey', 4, 'BFS'))", "WITH RECURSIVE r AS (SELECT 900 AS node, 0 AS d UNION SELECT o_custkey, d + 1 FROM r JOIN orders ON o_orderkey = node WHERE d < 4) SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT node FROM r)", ("orders",))
_dialect("sql_graph_rag", "SELECT node_id, score, context FROM embeddings GRAPH_RAG 'what is near' LIMIT 5 WITH SCORE > 0.01 WITH CONTEXT TOP_K 20", "SELECT vec_id AS node_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(range(64), lambda x: 1.0::DOUBLE)), 6) AS score, 'node ' || vec_id AS context FROM embeddings WHERE score > 0.01 ORDER BY score DESC, vec_id LIMIT 5", ("embeddings",))


@R.code("sql_vector_index", "SELECT vec_id, round(list_distance(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 5)), 5) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 1")
def _(t):
    """The nearest vector through an index; the vector asked for is itself in the table."""
    t("embeddings").createOrReplaceTempView("embeddings")
    db = Database(t("embeddings").sparkSession)
    db.query("CREATE VECTOR INDEX near ON embeddings (embedding) KEY (vec_id)")
    asked = "ARRAY(" + ", ".join(f"{x!r}" for x in t("embeddings").where("vec_id = 5").first().embedding) + ")"
    found = db.query(f"SELECT vec_id FROM embeddings ORDER BY VEC_DISTANCE_L2(embedding, {asked}) LIMIT 1")
    return found.withColumn("distance", F.round("distance", 5))
