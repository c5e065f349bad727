"""Graph operators move no more than they must: what is written, dealt out and held in one task."""

from pyspark.sql import functions as F

from strata.operators import graph
from strata.scratch import in_buckets


def test_k_core_writes_its_edges_seldom(spark, monkeypatch):
    """A path of 24 nodes peels from both ends in 12 rounds; its edges are written when half of them are gone."""
    tags = []
    for name in ("materialize", "in_buckets"):
        if hasattr(graph, name):
            monkeypatch.setattr(graph, name, lambda df, tag, *a, f=getattr(graph, name): tags.append(tag) or f(df, tag, *a))
    path = spark.range(23).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    loops = spark.createDataFrame([(3, 3), (99, 99)], "a long, b long")
    got = {r.node: r.core for r in graph.k_core(graph.load_edges(path.union(path).union(loops), "a", "b")).collect()}
    assert got == {v: 1 for v in range(24)} | {99: 0}
    assert tags.count("core-edges") <= 6


def test_rows_in_buckets_stay_where_they_are(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    kept = in_buckets(rows.union(rows), "test", "k", 4)
    joined = kept.join(rows.where("v = 1").select("k").hint("shuffle_hash"), "k")
    assert kept.count() == 1000
    assert joined.count() == 143
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort " not in plan


def spied(monkeypatch, module):
    """Plans of what the module materializes, by tag."""
    plans = {}
    real = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, tag, *a: plans.setdefault(tag, []).append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, tag, *a))
    return plans


def test_reach_does_not_gather_the_edges(spark, monkeypatch):
    """Only a step's reached nodes are made distinct, not the edges."""
    plans = spied(monkeypatch, graph)
    pairs = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (2, 11), (3, 11)], "a long, b long")
    got = graph.bidirectional(graph.load_edges(pairs, "a", "b"), 1, 2).collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 2), (10, 1)]
    assert plans["bfs"][0].count("Aggregate") == 1


def test_degree_deals_out_edges_before_repeats_go(spark, monkeypatch):
    plans = spied(monkeypatch, graph)
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (2, 3), (4, 4)], "a long, b long")
    want = {(1, 1, 1 / 3), (2, 2, 2 / 3), (3, 1, 1 / 3), (4, 1, 1 / 3)}
    assert {tuple(r) for r in graph.degree(graph.load_edges(pairs, "a", "b", directed=False)).collect()} == want
    assert "RepartitionByExpression" in plans["degree"][0]
    assert {tuple(r) for r in graph.degree(graph.load_edges(pairs, "a", "b"), once=True).collect()} == want


def test_components_contract_within_tasks(spark, monkeypatch):
    """Edges are read once; what is dealt out is a row per node and task."""
    plans = spied(monkeypatch, graph)
    dense = spark.range(0, 4000, 1, 4).select((F.col("id") % 40).alias("a"), (F.col("id") * 7 % 40).alias("b"))
    path = spark.range(100, 160, 1, 3).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    loop = spark.createDataFrame([(500, 500), (-3, 160), (-3, None)], "a long, b long")
    rows = dense.union(path.orderBy(F.xxhash64("a"))).union(loop)
    near = {}
    for a, b in rows.where("b IS NOT NULL").collect():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for v in sorted(near):
        todo = [] if v in want else [v]
        while todo:
            if (w := todo.pop()) not in want:
                want[w] = v
                todo += near[w]
    got = {r.node: r.component for r in graph.components(graph.load_edges(rows, "a", "b")).collect()}
    assert got == want
    monkeypatch.setattr(graph, "ONE_TASK_LINKS", 0)
    assert {r.node: r.component for r in graph.components(graph.load_edges(rows.where("a >= 0 AND a <> 500"), "a", "b")).collect()} == {v: c for v, c in want.items() if v not in (-3, 500)} | {v: 100 for v in range(100, 161)}
    monkeypatch.undo()
    assert len(plans["forest"]) == 2
    words = spark.createDataFrame([("b", "c"), ("a", "b"), ("x", "y")], "a string, b string")
    assert {r.node: r.component for r in graph.components(graph.load_edges(words, "a", "b")).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
