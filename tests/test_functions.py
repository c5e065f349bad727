"""Literal expectations for scalar functions, the dialect, and operators with small inputs."""

import random
from collections import defaultdict, deque
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strata.dialect import Database, rewrite
from strata.functions import dates, scalar, vector
from strata.operators import aggregates as agg
from strata.operators import dml, graph, timeseries, vectors


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("build", "want"),
    [
        (lambda: scalar.round_half_away(F.lit(2.5)), 3.0),
        (lambda: scalar.instr(F.lit("hello"), "lo"), 4),
        (lambda: scalar.instr(F.lit("hello"), "zz"), 0),
        (lambda: F.substring(F.lit("hello"), 2, 3), "ell"),
        (lambda: scalar.sign(F.lit(-7)), -1),
        (lambda: scalar.unicode(F.lit("")), None),
        (lambda: scalar.unicode(F.lit("€")), 8364),
        (lambda: scalar.char(72, 105, 128512), "Hi😀"),
        (lambda: scalar.unhex_text(F.lit("4869")), "Hi"),
        (lambda: scalar.quote(F.lit("it's")), "'it''s'"),
        (lambda: scalar.quote(F.lit(None).cast("string")), "NULL"),
        (lambda: scalar.quote(F.lit(True), "boolean"), "1"),
        (lambda: scalar.quote(F.unhex(F.lit("0AFF")), "binary"), "X'0AFF'"),
        (lambda: scalar.glob(F.lit("Alice"), "Al*"), True),
        (lambda: scalar.glob(F.lit("Bob"), "?ob"), True),
        (lambda: scalar.glob(F.lit("dan"), "[A-C]*"), False),
        (lambda: scalar.glob(F.lit("Bob"), "[A-C]*"), True),
        (lambda: scalar.not_regexp(F.lit(None).cast("string"), "a"), True),
        (lambda: dates.unixepoch(F.lit("2000-01-01T00:00:00").cast("timestamp_ntz")), 946684800),
        (lambda: dates.julianday(F.lit("2000-01-01 12:00:00").cast("timestamp_ntz")), 2451545.0),
        (lambda: dates.strftime("%Y-%m-%d", F.lit("2024-07-15").cast("timestamp_ntz"), "start of month"), "2024-07-01"),
        (lambda: F.length(scalar.ulid()), 26),
        (lambda: vector.cosine_distance(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), 1.0),
        (lambda: vector.dot_distance(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), -11.0),
        (lambda: vector.l2_distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))), 5.0),
        (lambda: vector.normalize(F.array(F.lit(0.0), F.lit(0.0))), [0.0, 0.0]),
    ],
)
def test_scalar(spark, build, want):
    assert one(spark, build()) == want


def test_errors(spark):
    for bad in (scalar.unhex_text(F.lit("ABC")), vector.l2_distance(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))):
        with pytest.raises(Exception, match="invalid hex|differ in dimension"):
            one(spark, bad)


def test_aggregates(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 4.0, ""), (3.0, 6.0, None), (3.0, 6.0, "b"), (1.0, 2.0, "a")], "x double, y double, s string")
    row = df.agg(agg.mode("x"), agg.corr("x", "y"), agg.corr("x", F.lit(1.0)), scalar.group_concat("s"), agg.percentile("x", 0.5), agg.total("x")).first()
    assert row[0] == 1.0 and abs(row[1] - 1) < 1e-12 and row[2] is None and row[3] == "a,a,b" and row[4] == 2.0 and row[5] == 10.0
    none = df.where("x > 9").agg(agg.total("x"), scalar.group_concat("s"), agg.corr("x", "y")).first()
    assert none[0] == 0.0 and none[1] is None and none[2] is None
    sales = spark.createDataFrame([("North", "Electronics", 500), ("North", "Food", 200), ("South", "Electronics", 300)], "r string, p string, a int")
    assert {tuple(r) for r in agg.pivot(sales, "r", "p", F.sum("a")).collect()} == {("North", 500, 200), ("South", 300, None)}


def test_dialect_leaves_literals_alone():
    assert rewrite("SELECT 'x IS SOME', \"IIF(a)\" -- GLOB 'a'") == "SELECT 'x IS SOME', \"IIF(a)\" -- GLOB 'a'"
    assert rewrite("a IS NOT SOME AND b IS NONE") == "a IS NULL AND b IS NULL"
    assert rewrite("SELECT TOP 3 x FROM t") == "SELECT x FROM t LIMIT 3"


def test_database(spark):
    spark.createDataFrame([(1, "Alice"), (2, "Bob")], "id int, name string").createOrReplaceTempView("people")
    db = Database(spark)
    db.procedure("By_Id", "SELECT name FROM people WHERE id = @id")
    assert db.execute("by_id", id=2).first()[0] == "Bob"
    assert db.query("SELECT MAX(1, 2) AS a, DATEADD(TIMESTAMP '2024-01-31 00:00:00', 1, 'day') AS b, LEN('abc') AS c").first().a == 2
    assert "people" in db.explain("SELECT * FROM people")


def test_time_series(spark):
    df = spark.createDataFrame([("2026-02-01 00:00:30", 1.0), ("2026-02-01 00:01:00", 3.0), ("2026-02-01 00:05:10", 5.0)], "t string, value double").selectExpr("CAST(t AS TIMESTAMP_NTZ) AS ts", "value")
    steps = timeseries.downsample(df, "2026-02-01 00:00:00", "2026-02-01 00:05:30", 120).orderBy("bucket").collect()
    assert [(r.n, r.avg) for r in steps] == [(2, 2.0), (0, None), (1, 5.0)]
    assert str(steps[-1].bucket_end) == "2026-02-01 00:05:30"
    assert df.where("value = 1").agg(*timeseries.stats()).first().stddev == 0.0


def test_dml(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id int, name string, n int")
    new = spark.createDataFrame([(2, "B", 7), (3, "c", 9)], "id int, name string, n int")
    up = dml.upsert(t, new, ["id"], {"name": "excluded.name", "n": "coalesce(target.n, 0) + excluded.n"})
    assert sorted(map(tuple, up.collect())) == [(1, "a", 5), (2, "B", 7), (3, "c", 9)]
    with pytest.raises(ValueError, match="conflict"):
        dml.insert_or_abort(t, new, ["id"])
    assert dml.check_violations(t, "n > 5").count() == 1


def test_versions(spark, tmp_path):
    table = dml.VersionedTable(spark, f"file://{tmp_path}/t")
    v1 = table.commit(spark.range(5).toDF("x"))
    table.commit(spark.range(9).toDF("x"))
    assert table.read().count() == 9 and table.read(v1).count() == 5
    table.restore(v1)
    assert table.read().count() == 5 and table.vacuum() == 2 and table.versions() == [3]


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(70)} | {(100, 101), (101, 102)})
    df = graph.load_edges(spark.createDataFrame(pairs, "a long, b long"), "a", "b", directed=False).cache()
    adj = defaultdict(set)
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    return df, adj


def test_graph_against_brute_force(random_graph):
    df, adj = random_graph

    def reach(start):
        d, queue = {start: 0}, deque([start])
        while queue:
            v = queue.popleft()
            for w in adj[v] - d.keys():
                d[w] = d[v] + 1
                queue.append(w)
        return d

    start = min(adj)
    assert {r.node: r.depth for r in graph.bfs(df, start, 2).collect()} == {v: d for v, d in reach(start).items() if d <= 2}
    assert {r.node: r.component for r in graph.components(df).collect()} == {v: min(reach(v)) for v in adj}
    tri = {(a, b, c) for a, b, c in combinations(sorted(adj), 3) if b in adj[a] and c in adj[a] and c in adj[b]}
    assert {tuple(r) for r in graph.triangles(df).collect()} == tri
    core, left, k = {}, {v: set(ns) for v, ns in adj.items()}, 0
    while left:
        weak = [v for v, ns in left.items() if len(ns) <= k]
        if not weak:
            k += 1
        for v in weak:
            core[v] = k
            for w in left.pop(v):
                left[w].discard(v)
    assert {r.node: r.core for r in graph.k_core(df).collect()} == core
    path = graph.shortest_path(df, 100, 102).first()
    assert path.cost == 2.0 and path.path == [100, 101, 102]
    assert graph.shortest_path(df, start, 100).count() == 0
    got = {tuple(r.clique) for r in graph.cliques(df).collect()}
    assert all(all(b in adj[a] for a, b in combinations(c, 2)) for c in got) and all(any(set(t) <= set(c) for c in got) for t in tri)


def test_betweenness_of_a_path(spark):
    df = graph.load_edges(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"), "a", "b", directed=False)
    assert {r.node: round(r.betweenness, 6) for r in graph.betweenness(df).collect()} == {1: 0.0, 2: round(2 / 3, 6), 3: round(2 / 3, 6), 4: 0.0}
    assert len({r.community for r in graph.louvain(df).collect()}) == 2


def test_ivf_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = e.where("vec_id % 20 = 0")
    exact = {(r.query_id, r.id) for r in vectors.knn(e, asked, 10).collect()}
    found = {(r.query_id, r.id) for r in vectors.IvfIndex(e).search(asked, 10, probes=24).collect()}
    assert len(exact & found) / len(exact) >= 0.9
