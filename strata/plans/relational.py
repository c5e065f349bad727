"""Scans, filters, joins, sets, subqueries, CTEs, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import relational as rel
from .base import Registry

R = Registry()

# -- scans, projection, predicates
R.sql("pricing_summary", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
    GROUP BY l_returnflag, l_linestatus""")
R.sql("scan_all", "SELECT * FROM nation")
R.sql("scan_project", "SELECT o_orderkey, o_custkey, o_totalprice * 1.1 AS gross FROM orders")
R.sql("pk_lookup", "SELECT * FROM orders WHERE o_orderkey = 7")
R.sql("range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
R.sql("filter_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_returnflag <> 'N'")
R.sql("filter_and_or", "SELECT p_partkey FROM part WHERE (p_size > 40 OR p_size < 5) AND (p_retailprice > 1000 OR p_brand = 'Brand#11')")
R.sql("filter_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey NOT IN (1, 2, 3)")
R.sql("filter_between", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_tax NOT BETWEEN 0.02 AND 0.06")
R.sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%_'")
R.sql("is_null", """
    SELECT c_custkey, x IS NULL AS gone, x IS NOT NULL AS there
    FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS x FROM customer)""")
R.sql("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
R.sql("select_literals", "SELECT 1 AS one, 'text' AS t, 1 + 2 * 3 AS seven, upper('abc') AS up, CAST(NULL AS INT) AS nothing")
R.sql("case_when", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer")


@R.code("filter_glob", "SELECT p_partkey, p_name FROM part WHERE p_name GLOB '*[a-c]?*' AND NOT p_name GLOB 'z*'")
def _(t):
    name = F.col("p_name")
    return t("part").where(scalar.glob(name, "*[a-c]?*") & ~scalar.glob(name, "z*")).select("p_partkey", "p_name")


@R.code("filter_regexp", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[02468]$') AND NOT coalesce(regexp_matches(nullif(c_mktsegment, 'BUILDING'), '^A'), false)")
def _(t):
    segment = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return t("customer").where(F.col("c_name").rlike("[02468]$") & scalar.not_regexp(segment, "^A")).select("c_custkey", "c_name")


@R.code("is_some_none", "SELECT o_orderkey, x IS NOT NULL AS has_x, x FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS x FROM orders)")
def _(t):
    rows = t("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("x"))
    return rel.optionally(rows, "x").select("o_orderkey", F.col("x.is_some").alias("has_x"), F.col("x.value").alias("x"))


@R.code("unwrap_default", "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '1-URGENT'), 'none') AS p FROM orders")
def _(t):
    rows = t("orders").withColumn("p", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return rows.select("o_orderkey", rel.unwrap("p", "none").alias("p"))


@R.code("params_bound", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _(t):
    orders = t("orders")
    return rel.bound(orders.sparkSession, "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = :s AND o_totalprice > :p", {"s": "F", "p": 100000}, orders=orders)


@R.code("tenant_policy", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = 5")
def _(t):
    return rel.TenantPolicy("c_nationkey", 5).read(t("customer")).select("c_custkey", "c_nationkey")


@R.code("tenant_rejects", "SELECT count(*) FILTER (WHERE c_nationkey <> 5) AS rejected FROM customer")
def _(t):
    return rel.TenantPolicy("c_nationkey", 5).violations(t("customer")).agg(F.count(F.lit(1)).alias("rejected"))


@R.code("expression_index", "SELECT length(c_name) AS k, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'machinery' GROUP BY 1")
def _(t):
    rows = rel.with_expressions(t("customer"), seg="lower(c_mktsegment)", k="length(c_name)")
    return rel.partial(rows, "seg = 'machinery'").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@R.code("typed_query", "SELECT o_orderpriority AS p, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE starts_with(o_orderpriority, '1') OR contains(o_orderpriority, 'LOW') GROUP BY 1")
def _(t):
    p = F.col("o_orderpriority")
    return t("orders").where(p.startswith("1") | p.contains("LOW")).groupBy(p.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))


@R.code("collate_nocase", "SELECT lower(c_mktsegment) AS seg, count(*) AS n FROM customer WHERE lower(c_mktsegment) IN ('building', 'automobile') GROUP BY 1")
def _(t):
    seg = rel.collated("c_mktsegment", "NOCASE")
    rows = t("customer").where((seg == "building") | (seg == "AutoMobile"))
    return rows.groupBy(seg.alias("k")).agg(F.count(F.lit(1)).alias("n")).select(F.lower(F.collate("k", "UTF8_BINARY")).alias("seg"), "n")


@R.code("collate_rtrim", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    padded = t("orders").withColumn("s", F.concat("o_orderstatus", F.lit("   ")))
    return padded.where(rel.collated("s", "RTRIM") == "F").agg(F.count(F.lit(1)).alias("n"))


# -- sorting and limits
R.sql("order_multi", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus ASC, o_totalprice DESC, o_orderkey")
R.sql("order_ordinal", "SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2")
R.sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
R.sql("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
R.sql("order_nulls", "SELECT c_custkey, x FROM (SELECT c_custkey, nullif(c_nationkey, 0) AS x FROM customer) ORDER BY x ASC NULLS FIRST, c_custkey")

# -- set operations
R.sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
R.sql("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
R.sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
R.sql("except", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
R.sql("setop_order_limit", "SELECT n_name AS x FROM nation UNION SELECT r_name FROM region ORDER BY x DESC LIMIT 7")

# -- CTEs and views
R.sql("cte_simple", "WITH big(k, p) AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT k, count(*) AS n FROM big GROUP BY k")
R.sql("cte_recursive_count", "WITH RECURSIVE cnt(n) MAX RECURSION LEVEL 10000 AS (SELECT 1 UNION ALL SELECT n + 1 FROM cnt WHERE n < 500) SELECT n FROM cnt", "WITH RECURSIVE cnt(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM cnt WHERE n < 500) SELECT n FROM cnt")


@R.code("view_query", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rel.create_view(joined, "customer_nation")
    return joined.sparkSession.sql("SELECT n_name, count(*) AS n FROM customer_nation GROUP BY n_name")


@R.code("materialized_view", "SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey")
def _(t):
    view = rel.MaterializedView(lambda: t("orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent")), "manual")
    return view.read()


# -- joins
R.sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
R.sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
R.sql("join_right", "SELECT s_suppkey, c_custkey FROM customer RIGHT JOIN supplier ON c_custkey = s_suppkey * 20")
R.sql("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 1450")
R.sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
R.sql("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
R.sql("join_three_way", "SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
R.sql("join_theta", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey >= n_nationkey AND s_acctbal > n_nationkey * 300")
R.sql("join_literal_on", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_orderkey = -99999")
R.sql("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 300000)")
R.sql("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")
R.sql("join_using", "SELECT n_nationkey, a.n_name FROM nation a JOIN nation b USING (n_nationkey)")


@R.code("join_null_safe", """
    WITH a AS (SELECT c_custkey, nullif(c_nationkey, 7) AS k FROM customer), b AS (SELECT DISTINCT nullif(n_nationkey, 7) AS k FROM nation)
    SELECT c_custkey, b.k AS k FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k""")
def _(t):
    left = t("customer").select("c_custkey", F.nullif("c_nationkey", F.lit(7)).alias("k"))
    right = t("nation").select(F.nullif("n_nationkey", F.lit(7)).alias("k")).distinct()
    return rel.null_safe_join(left, right, ["k"]).select("c_custkey", "k")


@R.code("join_nocase", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON lower(a.n_name) = lower(b.n_name)")
def _(t):
    a = t("nation").select(F.col("n_nationkey").alias("x"), F.upper("n_name").alias("u"))
    b = t("nation").select(F.col("n_nationkey").alias("y"), F.lower("n_name").alias("l"))
    return a.join(b, rel.collated("u", "NOCASE") == rel.collated("l", "NOCASE")).select("x", "y")


@R.code("join_diagnostics", """
    SELECT count(DISTINCT c_custkey) FILTER (WHERE o_orderkey IS NOT NULL) AS matched_left,
           count(DISTINCT c_custkey) FILTER (WHERE o_orderkey IS NULL) AS unmatched_left
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def _(t):
    return rel.join_diagnostics(t("customer"), t("orders"), "c_custkey", "o_custkey").select("matched_left", "unmatched_left")


# -- subqueries
R.sql("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
R.sql("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
R.sql("not_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
R.sql("exists_correlated", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 20)")
R.sql("not_exists", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
R.sql("correlated_scalar", "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation")
R.sql("derived_table", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) d WHERE n >= 3")
R.sql("having_subquery", "SELECT o_custkey, sum(o_totalprice) > 0 AS pos, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / (SELECT count(*) FROM customer) FROM orders)")
