"""Graph queries: suppliers and parts (bipartite, all of lineitem), and trade between nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from .base import Registry

R = Registry()

_BIPARTITE = "SELECT DISTINCT l_suppkey AS s, 1000000 + l_partkey AS p FROM lineitem"
_TRADE = """
    all_trade AS (SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
      WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
    half AS (SELECT a, b, n FROM all_trade WHERE n > (SELECT 1.15 * avg(n) FROM all_trade)),
    e AS (SELECT CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst, n FROM half UNION ALL SELECT b, a, n FROM half)"""


def supplied(t):
    """A directed edge from supplier to part per row of lineitem, repeats included."""
    pairs = t("lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") + 1_000_000).alias("p"))
    return g.load_edges(pairs, "s", "p")


def trade(t):
    """Undirected edges between nations that trade more than 1.15 times the average."""
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.where("c_nationkey <> s_nationkey").select(F.least("c_nationkey", "s_nationkey").cast("long").alias("a"), F.greatest("c_nationkey", "s_nationkey").cast("long").alias("b"))
    counted = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    mean = counted.agg((1.15 * F.avg("n")).alias("mean"))
    kept = g.materialize(counted.crossJoin(F.broadcast(mean)).where("n > mean").select("a", "b", "n"), "trade")  # one row
    return g.load_edges(kept, "a", "b", "n", directed=False)


_REACH = """{extra} reach AS (SELECT 1 AS node, 0 AS d UNION SELECT e.dst, reach.d + 1 FROM reach JOIN e ON e.src = reach.node WHERE reach.d < {depth})
    SELECT CAST(node AS BIGINT) AS node, CAST(min(d) AS INT) AS depth FROM reach GROUP BY node"""


@R.code("bfs_depth", "WITH RECURSIVE b AS (" + _BIPARTITE + "), e AS (SELECT s AS src, p AS dst FROM b)," + _REACH.format(extra="", depth=3))
def _(t):
    return g.bfs(supplied(t), 1, 3)


@R.code("bidirectional_reach", "WITH RECURSIVE b AS (" + _BIPARTITE + "), e AS (SELECT s AS src, p AS dst FROM b UNION ALL SELECT p, s FROM b)," + _REACH.format(extra="", depth=2))
def _(t):
    return g.bidirectional(supplied(t), 1, 2)


@R.code("graph_traverse", "WITH RECURSIVE " + _TRADE + "," + _REACH.format(extra="", depth=2).replace("CAST(node AS BIGINT) AS node, CAST(min(d) AS INT) AS depth FROM reach GROUP BY node", "DISTINCT CAST(node AS BIGINT) AS node FROM reach"))
def _(t):
    return g.traverse(trade(t), 1, 2, "bfs")


_COSTS = """c AS (SELECT src, dst, 1000.0 / n AS weight FROM e),
    d(node, cost) USING KEY (node) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS DOUBLE) UNION
      SELECT c.dst, CAST(min(d.cost + c.weight) AS DOUBLE) FROM d JOIN c ON c.src = d.node LEFT JOIN recurring.d AS r ON r.node = c.dst
      WHERE r.cost IS NULL OR d.cost + c.weight < r.cost GROUP BY c.dst)"""


def costly(t):
    return trade(t).withColumn("weight", 1000.0 / F.col("weight"))


@R.code("dijkstra_reach", "WITH RECURSIVE " + _TRADE + ", " + _COSTS + " SELECT node, round(cost, 6) AS cost FROM d WHERE cost <= 100")
def _(t):
    return g.dijkstra_reach(costly(t), 1, 100.0).withColumn("cost", F.round("cost", 6))


@R.code("shortest_path", "WITH RECURSIVE " + _TRADE + ", " + _COSTS + " SELECT node AS goal, round(cost, 6) AS cost, CAST(1 AS BIGINT) AS first FROM d ORDER BY d.cost DESC, node LIMIT 1")
def _(t):
    """To the node that is farthest from nation 1 (that nation itself if it has no edge)."""
    edges = g.materialize(costly(t), "costly")
    far = g.dijkstra_reach(edges, 1, float("inf")).orderBy(F.desc("cost"), "node").first()
    found = g.shortest_path(edges, 1, far.node, g.heuristic(edges, far.node, "weighted_cost"))
    return found.select(F.element_at("path", -1).alias("goal"), F.round("cost", 6).alias("cost"), F.element_at("path", 1).alias("first"))


@R.code("degree", "WITH b AS (" + _BIPARTITE + "), e AS (SELECT s AS src FROM b UNION ALL SELECT p FROM b) SELECT src AS node, count(*) AS degree, round(count(*) / ((SELECT count(DISTINCT src) FROM e) - 1), 9) AS centrality FROM e GROUP BY src")
def _(t):
    return g.degree(supplied(t), once=True).withColumn("centrality", F.round("centrality", 9))


@R.code("closeness", "WITH RECURSIVE " + _TRADE + """, r AS (SELECT DISTINCT src AS s, src AS node, 0 AS d FROM e UNION SELECT r.s, e.dst, r.d + 1 FROM r JOIN e ON e.src = r.node WHERE r.d < 24),
    m AS (SELECT s, node, min(d) AS d FROM r GROUP BY 1, 2)
    SELECT s AS node, round((count(*) - 1) / sum(d), 8) AS closeness FROM m GROUP BY s""")
def _(t):
    return g.closeness(trade(t)).withColumn("closeness", F.round("closeness", 8))


@R.code("betweenness")
def _(t):
    return g.betweenness(trade(t)).withColumn("betweenness", F.round("betweenness", 8))


@R.code("eigenvector")
def _(t):
    return g.eigenvector(trade(t)).withColumn("score", F.round("score", 4))


@R.code("triangles", "WITH " + _TRADE + " SELECT x.src AS a, x.dst AS b, z.dst AS c FROM e x JOIN e y ON x.dst = y.src AND x.src < x.dst AND y.src < y.dst JOIN e z ON z.src = x.src AND z.dst = y.dst")
def _(t):
    return g.triangles(trade(t))


@R.code("clustering_coeff", "WITH " + _TRADE + """, t AS (SELECT x.src AS node, count(*) / 2 AS k FROM e x JOIN e y ON x.src = y.src AND x.dst <> y.dst JOIN e z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1),
    d AS (SELECT src AS node, count(*) AS d FROM e GROUP BY 1)
    SELECT node, round(coalesce(CASE WHEN d > 1 THEN 2 * coalesce(k, 0) / (d * (d - 1)) END, 0), 8) AS coefficient FROM d LEFT JOIN t USING (node)""")
def _(t):
    return g.clustering_coefficient(trade(t)).withColumn("coefficient", F.round("coefficient", 8))


@R.code("components", "WITH RECURSIVE " + _TRADE + ", r AS (SELECT DISTINCT src AS node, src AS label FROM e UNION SELECT e.dst, r.label FROM r JOIN e ON e.src = r.node) SELECT node, min(label) AS component FROM r GROUP BY node")
def _(t):
    return g.components(trade(t))


@R.code("components_bipartite", "WITH RECURSIVE b AS (" + _BIPARTITE + "), e AS (SELECT s AS src, p AS dst FROM b UNION ALL SELECT p, s FROM b), l(node, label) USING KEY (node) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, min(l.label) FROM l JOIN e ON e.src = l.node JOIN recurring.l AS r ON r.node = e.dst WHERE l.label < r.label GROUP BY e.dst) SELECT node, label AS component FROM l")
def _(t):
    return g.components(supplied(t))


@R.code("density", "WITH " + _TRADE + " SELECT count(DISTINCT src) AS nodes, CAST(count(*) / 2 AS BIGINT) AS edges, round(count(*) / (count(DISTINCT src) * (count(DISTINCT src) - 1)), 9) AS density FROM e")
def _(t):
    return g.density(trade(t)).withColumn("density", F.round("density", 9))


@R.code("k_core")
def _(t):
    return g.k_core(supplied(t))


@R.code("label_prop")
def _(t):
    return g.label_propagation(trade(t))


@R.code("louvain")
def _(t):
    return g.louvain(trade(t))


@R.code("cliques")
def _(t):
    return g.cliques(trade(t))


@R.code("temporal_ranking", "SELECT event_id, round(0.5 * value / 100 + 0.5 * (0.3 * greatest(0, 1 - date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') / 30) + 0.2 * least(1, user_id / 10)), 8) AS score FROM events")
def _(t):
    rows = t("events").select("event_id", (F.col("value") / 100).alias("s"), F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts")).alias("age"), "user_id")
    return g.temporal_rank(rows, "s", "age", "user_id").select("event_id", F.round("score", 8).alias("score"))


@R.code("enhanced_ranking", "WITH " + _TRADE + """, d AS (SELECT src AS node, count(*) AS d FROM e GROUP BY 1)
    SELECT CAST(n_nationkey AS BIGINT) AS node, round(0.5 * n_nationkey / 25 + 0.3 * coalesce(d / (SELECT max(d) FROM d), 0) + 0.2 * CAST(n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 1) AS INT), 8) AS score
    FROM nation LEFT JOIN d ON node = n_nationkey""")
def _(t):
    scored = t("nation").select(F.col("n_nationkey").cast("long").alias("node"), (F.col("n_nationkey") / 25).alias("semantic"))
    communities = t("nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("community"))
    return g.enhanced_rank(scored, trade(t), communities, 1).withColumn("score", F.round("score", 8))


@R.code("graph_rag")
def _(t):
    nodes = t("embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    ring = t("embeddings").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return g.graph_rag(nodes, [1.0] * 64, edges=g.load_edges(ring, "a", "b", directed=False)).withColumn("score", F.round("score", 6))
