"""Graph, vector and shard operators that SQL does not express, against brute force on small random graphs."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import graph, sharding, vectors


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(4)
    return sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(60)})


@pytest.fixture(scope="module")
def edges(spark, pairs):
    rows = [(a, b, float(1 + (a * b) % 5)) for a, b in pairs]
    return graph.load_edges(spark.createDataFrame(rows, "a long, b long, w double"), "a", "b", "w", directed=False)


def neighbours(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
        out[b].add(a)
    return out


def test_eigenvector(edges, pairs):
    nodes = sorted({x for p in pairs for x in p})
    a = np.zeros((len(nodes), len(nodes)))
    for x, y in pairs:
        a[nodes.index(x), nodes.index(y)] = a[nodes.index(y), nodes.index(x)] = 1
    values, vectors_ = np.linalg.eigh(a)
    want = np.abs(vectors_[:, values.argmax()])
    got = {r.node: r.score for r in graph.eigenvector(edges).collect()}
    assert all(abs(got[n] - w) < 1e-3 for n, w in zip(nodes, want, strict=True))


def test_label_propagation(edges, pairs):
    near = neighbours(pairs)
    label = {v: v for v in near}
    for _ in range(100):
        new = {}
        for v, own in near.items():
            votes = defaultdict(int)
            for w in own:
                votes[label[w]] += 1
            new[v] = min(votes, key=lambda c: (-votes[c], c))
        done, label = new == label, new
        if done:
            break
    assert {r.node: r.community for r in graph.label_propagation(edges).collect()} == label


def test_cliques_are_all_the_maximal_ones(edges, pairs):
    near = neighbours(pairs)
    cliques = [set(c) for n in range(2, 7) for c in itertools.combinations(sorted(near), n) if all(b in near[a] for a, b in itertools.combinations(c, 2))]
    want = sorted(sorted(c) for c in cliques if not any(c < d for d in cliques) and len(c) >= 3)
    got = sorted(r.clique for r in graph.cliques(edges).collect() if len(r.clique) >= 3)
    assert got == want


def test_louvain_moves_do_not_lower_modularity(edges, pairs):
    weight = {p: float(1 + (p[0] * p[1]) % 5) for p in pairs}
    strength = defaultdict(float)
    for (a, b), w in weight.items():
        strength[a] += w
        strength[b] += w
    total = sum(weight.values())

    def modularity(where):
        inside, mass = defaultdict(float), defaultdict(float)
        for (a, b), w in weight.items():
            inside[where[a]] += w * (where[a] == where[b])
        for v, s in strength.items():
            mass[where[v]] += s
        return sum(inside[c] / total - (mass[c] / (2 * total)) ** 2 for c in mass)

    got = {r.node: r.community for r in graph.louvain(edges).collect()}
    assert set(got) == set(strength) and modularity(got) > modularity({v: v for v in strength})
    best = modularity(got)
    for v in strength:  # a local optimum: no single node gains by moving
        for c in set(got.values()):
            assert modularity({**got, v: c}) <= best + 1e-9


@pytest.mark.parametrize("kind", ["none", "uniform", "weighted_cost", "euclidean", "manhattan"])
def test_shortest_path_and_heuristics(spark, kind):
    rng = random.Random(9)
    places = {i: (rng.random(), rng.random()) for i in range(30)}
    rows = []
    for a, b in {tuple(rng.sample(range(30), 2)) for _ in range(110)}:
        gap = sum(abs(x - y) for x, y in zip(places[a], places[b], strict=True))
        rows.append((a, b, gap * (1 + rng.random()) + 0.01))
    cost = {0: 0.0}
    for _ in range(30):
        for a, b, w in rows:
            if a in cost and cost[a] + w < cost.get(b, 1e9):
                cost[b] = cost[a] + w
    edges = graph.load_edges(spark.createDataFrame(rows, "a long, b long, w double"), "a", "b", "w")
    spots = spark.createDataFrame([(i, *p) for i, p in places.items()], "node long, x double, y double")
    goal = max((v for v in cost if v), key=cost.get)
    ahead = None if kind == "none" else graph.heuristic(edges, goal, kind, spots)
    found = graph.shortest_path(edges, 0, goal, ahead).first()
    weight = {(a, b): w for a, b, w in rows}
    assert abs(found.cost - cost[goal]) < 1e-9 and found.path[0] == 0 and found.path[-1] == goal
    assert abs(sum(weight[p] for p in itertools.pairwise(found.path)) - found.cost) < 1e-9 and found.expanded > 0
    assert graph.shortest_path(edges, goal, goal).first().cost == 0


def test_multi_hop_boost(spark, edges, pairs):
    near = neighbours(pairs)
    depth = {0: 0}
    for d in range(1, 4):
        for v in [x for x in depth if depth[x] == d - 1]:
            for w in near[v]:
                depth.setdefault(w, d)
    scored = spark.createDataFrame([(v, 0.04 * v) for v in near], "node long, semantic double")
    got = {r.node: r.score for r in graph.multi_hop_boost(scored, edges, 0).collect()}
    for v in near:
        want = min(1.0, 0.04 * v * (1 + (3 - depth[v]) * 0.1)) if v in depth else 0.04 * v
        assert abs(got[v] - want) < 1e-9


def test_hash_shards(spark):
    """The same shard wherever the rows lie, all shards used evenly, NULL in 0."""
    rows = spark.range(4000)
    one = {r.id: r.s for r in rows.select("id", sharding.hash_shard(F.col("id"), 8).alias("s")).collect()}
    two = {r.id: r.s for r in rows.repartition(5).select("id", sharding.hash_shard(F.col("id"), 8).alias("s")).collect()}
    assert one == two and all(400 < list(one.values()).count(s) < 600 for s in range(8))
    assert rows.limit(1).select(sharding.hash_shard(F.lit(None).cast("long"), 8).alias("s")).first().s == 0
    both = [r.s for r in rows.select(sharding.composite_shard([F.col("id"), F.col("id") % 3], 8).alias("s")).collect()]
    assert all(400 < both.count(s) < 600 for s in range(8))


def test_layout_hints(spark, tmp_path):
    from strata.sources.tables import Layouts

    hints = Layouts(spark.range(10).withColumnRenamed("id", "a")).add("x", "a", f"file://{tmp_path}/x").add("y", "a", f"file://{tmp_path}/y")
    assert hints.choose("a") == "x" and hints.choose("b") is None
    assert hints.prefer("y").choose("a") == "y" and hints.avoid("y").choose("a") == "x"
    with pytest.raises(ValueError, match="cannot serve"):
        hints.force("y").scan("a")


def test_closeness_in_blocks(edges):
    key = lambda r: r.node
    assert sorted(graph.closeness(edges).collect(), key=key) == sorted(graph.closeness(edges, most_pairs=100).collect(), key=key)


def test_knn_counts_every_query_row(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(60, 4)).round(1)
    ids = [None if i % 7 == 0 else i // 2 for i in range(60)]
    rows = [(a, x.tolist()) for a, x in zip(ids, data, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(vectors, "BLOCK", 7)
    got = sorted((str(r.query_id), round(r.distance, 4)) for r in vectors.knn(df, df, 3).collect())
    want = []
    exact = np.array([x for _, x in rows], np.float32).astype(float)
    for i, q in enumerate(exact):
        near = sorted(round(float(np.linalg.norm(q - x)), 4) for j, x in enumerate(exact) if ids[j] is None or ids[j] != ids[i])[:3]
        want += [(str(ids[i]), d) for d in near]
    assert [k for k, _ in got] == sorted(k for k, _ in want)
    assert np.allclose([d for _, d in got], [d for _, d in sorted(want)], atol=2e-4)


def test_saved_index_finds_the_same(spark, tmp_path):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 8)))], "vec_id long, embedding array<float>")
    index = vectors.IvfIndex(df)
    index.save(f"file://{tmp_path}/index")
    again = vectors.IvfIndex.load(spark, f"file://{tmp_path}/index")
    asked = df.where("vec_id % 20 = 0")
    key = lambda r: (r.query_id, r.rank)
    first, second = (sorted(x.search(asked, 5, probes=14).collect(), key=key) for x in (index, again))
    assert first == second
    exact = {(r.query_id, r.id) for r in vectors.knn(df, asked, 5).collect()}
    assert len(exact & {(r.query_id, r.id) for r in first}) >= 0.9 * len(exact)
