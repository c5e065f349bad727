"""Graph operators over edge tables (src, dst[, weight]).

Iterations are joins of a frontier with the edges; each round is written to the shared
folder, so lineage stays short and a lost executor costs one round. Algorithms that need a whole
graph in one place (betweenness, Louvain, cliques) check its size first and refuse larger ones.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import in_buckets, materialize, tasks_for

#: Most edges that one task may hold for the algorithms that need the whole graph.
WHOLE_GRAPH_EDGES = 2_000_000


def load_edges(df: DataFrame, src: str, dst: str, weight: str | None = None, directed: bool = True) -> DataFrame:
    """src, dst, weight (default 1; not positive counts as 1); both directions if undirected. NULL ends are dropped."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    edges = df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.when(w > 0, w).otherwise(1.0).alias("weight")).where("src IS NOT NULL AND dst IS NOT NULL")
    return edges if directed else edges.union(edges.select("dst", "src", "weight"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def bfs(edges: DataFrame, start, depth: int) -> DataFrame:
    """node, depth: everything within `depth` steps, the start included. Repeated edges only repeat reached nodes, so edges stay as they are."""
    edges = edges.select("src", "dst")
    kind = dict(edges.dtypes)["src"]
    seen = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def bidirectional(edges: DataFrame, start, depth: int) -> DataFrame:
    return bfs(edges.select("src", "dst").union(edges.select("dst", "src")), start, depth)


def dijkstra_reach(edges: DataFrame, start, most: float) -> DataFrame:
    """node, cost: everything whose least cost is at most `most`."""
    cheapest = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    kind = dict(edges.dtypes)["src"]
    known = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0.0).alias("cost"))
    frontier = known
    while not frontier.isEmpty():
        step = cheapest.join(frontier, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("new"))
        step = step.where(F.col("new") <= most).groupBy("node").agg(F.min("new").alias("new"))
        merged = known.join(step, "node", "full").select("node", F.least("cost", "new").alias("cost"), (F.col("new") < F.coalesce("cost", F.lit(float("inf")))).alias("better"))
        merged = materialize(merged, "dijkstra")
        known, frontier = merged.select("node", "cost"), merged.where("better").select("node", "cost")
    return known


HEURISTICS = ("uniform", "depth", "weighted_cost", "manhattan", "euclidean")


def heuristic(edges: DataFrame, goal, kind: str = "uniform", positions: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """node, ahead: a lower bound of the cost from each node to the goal, from positions (node, x, y) where the kind needs them.

    uniform: 0; depth: one step, for edges of cost 1 or more; weighted_cost: the cheapest edge; manhattan and euclidean:
    the distance, times scale. A bound must not exceed the true cost.
    """
    here = F.col("node") == F.lit(goal)
    if kind in ("manhattan", "euclidean"):
        end = positions.where(here).select(F.col("x").alias("gx"), F.col("y").alias("gy")).limit(1)
        dx, dy = F.abs(F.col("x") - F.col("gx")), F.abs(F.col("y") - F.col("gy"))
        ahead = dx + dy if kind == "manhattan" else F.sqrt(dx * dx + dy * dy)
        return positions.crossJoin(F.broadcast(end)).select("node", (ahead * scale).cast("double").alias("ahead"))  # one row
    if kind not in HEURISTICS:
        raise ValueError(kind)
    least = edges.agg(F.min("weight").alias("least")) if kind == "weighted_cost" else edges.sparkSession.range(1).select(F.lit(1.0 if kind == "depth" else 0.0).alias("least"))
    return nodes(edges).crossJoin(F.broadcast(least)).select("node", F.when(here, 0.0).otherwise(F.col("least") * scale).alias("ahead"))  # one row


def shortest_path(edges: DataFrame, start, goal, ahead: DataFrame | None = None) -> DataFrame:
    """cost, path (array of nodes), expanded: the cheapest path from start to goal; no row without one. Ties: the smaller path.

    Rounds go on until no cheaper way is left. `ahead` (see heuristic) drops what cannot beat the best path so far;
    expanded counts the nodes whose edges were followed, once for each time.
    """
    cheapest = edges.groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    spark, kind = edges.sparkSession, dict(edges.dtypes)["src"]
    known = frontier = spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.struct(F.lit(0.0).alias("cost"), F.array(F.lit(start).cast(kind)).alias("path")).alias("best"))
    expanded, at_goal = 0, F.col("node") == F.lit(goal).cast(kind)
    while start != goal:
        if ahead is not None:
            bound = known.where(at_goal).select("best.cost").first()
            if bound:
                frontier = frontier.join(ahead, "node", "left").where(F.col("best.cost") + F.coalesce("ahead", F.lit(0.0)) <= bound.cost).select("node", "best")
        frontier = frontier.where(~at_goal)
        count = frontier.count()
        if not count:
            break
        expanded += count
        step = cheapest.join(frontier, F.col("src") == F.col("node")).where(~F.array_contains("best.path", F.col("dst")))
        made = F.struct((F.col("best.cost") + F.col("weight")).alias("cost"), F.array_append("best.path", F.col("dst")).alias("path"))
        step = step.select(F.col("dst").alias("node"), made.alias("new")).groupBy("node").agg(F.min("new").alias("new"))
        merged = known.join(step, "node", "full").select("node", F.least("best", "new").alias("best"), F.coalesce(F.col("new") < F.col("best"), F.col("new").isNotNull()).alias("better"))
        merged = materialize(merged, "path")
        known, frontier = merged.select("node", "best"), merged.where("better").select("node", "best")
    return known.where(at_goal).select("best.cost", "best.path", F.lit(expanded).alias("expanded"))


def degree(edges: DataFrame, once: bool = False) -> DataFrame:
    """node, degree, centrality (degree / (n - 1)) of an undirected graph with both directions; once: given in one of them.

    Edges are dealt out by both ends, about a million to a task, before repeats are dropped: no task's share grows with the table.
    """
    a, b = ("src", "dst") if not once else (F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    pairs = edges.select(a, b).repartition(tasks_for(edges), "src", "dst").distinct()
    if once:
        ends = pairs.select(F.explode(F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))).alias("node"))
    else:
        ends = pairs.select(F.col("src").alias("node"))
    per = materialize(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degree")
    n = (per if once else per.select("node").union(pairs.select("dst")).distinct()).agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(n)).select("node", "degree", F.try_divide(F.col("degree"), F.col("n") - 1).alias("centrality"))  # one row


def all_distances(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """source, node, d: breadth-first rounds from every source (default: every node); the result has a row per pair."""
    edges = edges.select("src", "dst").distinct()
    sources = nodes(edges) if sources is None else sources
    seen = frontier = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("d"))
    d = 0
    while True:
        d += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("d", F.lit(d)), "distances")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def closeness(edges: DataFrame, most_pairs: int = 200_000_000) -> DataFrame:
    """node, closeness: (reached - 1) / sum of distances; 0 for a node that reaches nothing.

    Sources go in blocks whose pairs with all nodes are at most `most_pairs` rows, so that is what is kept at a time; the time
    stays that of all pairs.
    """
    every = materialize(nodes(edges), "closeness-nodes")
    n = every.count()
    blocks, out = max(1, -(-n * n // most_pairs)), None
    for b in range(blocks):
        some = every.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == b)
        per = all_distances(edges, some).groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("r"), F.sum("d").alias("s"))
        per = per.select("node", F.coalesce(F.try_divide(F.col("r") - 1, F.col("s")), F.lit(0.0)).alias("closeness"))
        per = materialize(per, "closeness") if blocks > 1 else per
        out = per if out is None else out.union(per)
    return out


def eigenvector(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """node, score: power iteration, unit L2 norm."""
    edges = edges.select("src", "dst").distinct()
    score = nodes(edges).withColumn("score", F.lit(1.0))
    for _ in range(rounds):
        step = edges.join(score, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum("score").alias("new"))
        step = materialize(score.join(step, "node", "left").select("node", F.col("score").alias("old"), F.coalesce("new", F.lit(0.0)).alias("new")), "eigen")
        length = step.agg(F.sqrt(F.sum(F.col("new") * F.col("new")))).first()[0] or 1.0
        moved = step.agg(F.sqrt(F.sum(F.pow(F.col("new") / length - F.col("old"), 2)))).first()[0] or 0.0
        score = step.select("node", (F.col("new") / length).alias("score"))
        if moved < tolerance:
            break
    return score


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c. Edges go from the end of lower degree to the higher, so no node lists all its neighbours' pairs."""
    half = edges.where("src < dst").select("src", "dst").distinct()
    deg = half.select(F.col("src").alias("n")).union(half.select("dst")).groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    ranked = half.join(deg.select(F.col("n").alias("src"), F.col("k").alias("ks")), "src").join(deg.select(F.col("n").alias("dst"), F.col("k").alias("kd")), "dst")
    up = F.struct("ks", "src") < F.struct("kd", "dst")
    out = materialize(ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v")), "oriented")
    pair = out.alias("x").join(out.alias("y"), (F.col("x.u") == F.col("y.u")) & (F.col("x.v") < F.col("y.v")))
    pair = pair.select(F.col("x.u").alias("u"), F.col("x.v").alias("v"), F.col("y.v").alias("w"))
    closed = pair.join(half.select(F.col("src").alias("v"), F.col("dst").alias("w")), ["v", "w"])
    corner = F.array_sort(F.array("u", "v", "w"))
    return closed.select(corner[0].alias("a"), corner[1].alias("b"), corner[2].alias("c"))


def triangle_count(edges: DataFrame) -> DataFrame:
    found = triangles(edges)
    return found.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """node, coefficient: triangles / (d (d - 1) / 2), 0 below two neighbours."""
    d = edges.where("src <> dst").select("src", "dst").distinct().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    both = d.join(triangle_count(edges), "node", "left")
    return both.select("node", F.coalesce(F.try_divide(2 * F.coalesce("triangles", F.lit(0)), F.col("d") * (F.col("d") - 1)), F.lit(0.0)).alias("coefficient"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node).

    Each task first contracts the edges it reads to a forest: every node it saw and the smallest node that its edges lead to.
    A node's smallest root stands for it, and the roots that meet at a node are linked; the components of these links, a much
    smaller graph unless the edges are long paths, are found in one task up to ONE_TASK_LINKS (counted first), else by rounds.
    """
    kind = dict(edges.dtypes)["src"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        return _spread_labels(edges)
    ends = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").cast("long"), F.col("dst").cast("long"))
    forest = ends.mapInArrow(_forests, "node long, root long")
    forest = materialize(forest.withColumn("least", F.min("root").over(Window.partitionBy("node"))), "forest")
    links = materialize(forest.where("root <> least").select(F.col("root").alias("src"), F.col("least").alias("dst")).distinct(), "forest-links")
    tops = links.coalesce(1).mapInArrow(_forests, "node long, root long") if links.count() <= ONE_TASK_LINKS else _spread_labels(links)
    tops = tops.toDF("least", "top")
    placed = forest.where("root = least").select("node", "least").distinct().join(tops, "least", "left")
    return placed.select(F.col("node").cast(kind), F.coalesce("top", "least").cast(kind).alias("component"))


#: Edges that a task contracts at a time, and the nodes of a forest after which it starts another.
CONTRACT_EDGES, FOREST_NODES = 1_000_000, 2_000_000
#: Links that one task solves; their nodes are fewer than FOREST_NODES.
ONE_TASK_LINKS = 900_000


def _contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of these edges, and the smallest node of its component: roots hook to smaller roots, then paths are halved."""
    named, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(place.reshape(-1), 2)
    root = np.arange(len(named))
    while True:
        x, y = root[x], root[y]
        open_ = x != y
        if not open_.any():
            return named, named[root]
        x, y = x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst) -> (node, root), a row per node of the task's edges, or of as many as it holds at a time."""

    def rows(node, root):
        for i in range(0, len(node), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 50_000]), pa.array(root[i : i + 50_000])], ["node", "root"])

    node, root, fresh, held = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
    for batch in batches:
        fresh.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        held += batch.num_rows
        if held >= CONTRACT_EDGES:
            node, root = _contract(*(np.concatenate([f, *part]) for f, part in zip((node, root), zip(*fresh), strict=True)))
            fresh, held = [], 0
            if len(node) >= FOREST_NODES:
                yield from rows(node, root)
                node = root = np.empty(0, np.int64)
    if fresh:
        node, root = _contract(*(np.concatenate([f, *part]) for f, part in zip((node, root), zip(*fresh), strict=True)))
    yield from rows(node, root)


def _spread_labels(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): labels spread and jump to their label's label, so rounds are few on long paths; for nodes that are no integers."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    label = nodes(edges).withColumn("component", F.col("node"))
    while True:
        spread = both.join(label, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("near"))
        low = label.join(spread, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("component").alias("jump"))
        moved = materialize(low.join(jump, "mid").select("node", "old", F.least("mid", "jump").alias("component")), "components")
        label = moved.select("node", "component")
        if moved.where("component <> old").isEmpty():
            return label


def density(edges: DataFrame) -> DataFrame:
    half = edges.where("src < dst").select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("edges"))
    n = nodes(edges).agg(F.count(F.lit(1)).alias("nodes"))
    return n.crossJoin(half).select("nodes", "edges", F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)).alias("density"))  # one row each


def label_propagation(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, community: all nodes at once take their neighbours' most frequent label, the smallest on ties."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    label = nodes(edges).withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(label, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node"), "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("node").agg(F.max(F.struct("n", (-F.col("community")).alias("minus"))).alias("b")).select("node", (-F.col("b.minus")).alias("new"))
        moved = materialize(label.join(best, "node", "left").select("node", F.col("community").alias("old"), F.coalesce("new", "community").alias("community")), "labels")
        label = moved.select("node", "community")
        if moved.where("community <> old").isEmpty():
            break
    return label


def k_core(edges: DataFrame) -> DataFrame:
    """node, core: peeling, all nodes below k at once.

    The edges are written once, in buckets by src, and never shuffled again: a round joins the nodes that go with their edges
    in place and deals out one number per neighbour. Edges of nodes that are gone are dropped once they are half of all.
    """
    ends = edges.where("src <> dst").select("src", "dst")
    buckets = tasks_for(ends, 2)
    left = in_buckets(ends.union(ends.select("dst", "src")), "core-edges", "src", buckets)
    degrees = materialize(left.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("d")), "core-degrees")
    alone = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(degrees, "node", "left_anti")
    out, alive, k, ends_left = alone.withColumn("core", F.lit(0)), degrees, 1, lambda d: d.agg(F.min("d"), F.coalesce(F.sum("d"), F.lit(0))).first()
    least, total = ends_left(alive)
    kept = total
    while total:
        k = max(k, least)
        weak = alive.where(F.col("d") <= k).select("node")
        lost = left.join(weak.withColumnRenamed("node", "src").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("less"))
        state = alive.where(F.col("d") > k).join(lost, "node", "left").select("node", (F.col("d") - F.coalesce("less", F.lit(0))).alias("d"))
        state = materialize(state, "core-degrees")
        out = out.union(weak.union(state.where("d = 0").select("node")).withColumn("core", F.lit(k)))
        alive = state.where("d > 0")
        least, total = ends_left(alive)
        if total and 2 * total < kept:
            here = alive.select("node")
            left = left.join(here.withColumnRenamed("node", "src").hint("shuffle_hash"), "src", "left_semi").join(here.withColumnRenamed("node", "dst"), "dst", "left_semi")
            left = in_buckets(left.select("src", "dst"), "core-edges", "src", buckets)
            kept = total
    return out


def _whole(edges: DataFrame) -> DataFrame:
    n = edges.count()
    if n > WHOLE_GRAPH_EDGES:
        raise ValueError(f"{n} edges: this algorithm holds the graph in one task, at most {WHOLE_GRAPH_EDGES}")
    return edges


def _adjacency(pdf: pd.DataFrame) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = defaultdict(dict)
    for s, d, w in zip(pdf["src"], pdf["dst"], pdf["weight"], strict=True):
        if s != d:
            out[int(s)][int(d)] = out[int(d)][int(s)] = float(w)
    return out


def betweenness(edges: DataFrame) -> DataFrame:
    """node, betweenness (undirected, scaled 2 / ((n-1)(n-2))): Brandes, sources dealt over the tasks."""
    spark = edges.sparkSession
    graph = {k: sorted(v) for k, v in _adjacency(_whole(edges).toPandas()).items()}
    shared = spark.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adj, total = shared.value, defaultdict(float)
        for batch in batches:
            for source in batch["node"]:
                order, parents, paths, dist = [], defaultdict(list), defaultdict(float, {source: 1.0}), {source: 0}
                queue = deque([source])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in adj.get(v, ()):
                        if w not in dist:
                            dist[w] = dist[v] + 1
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            paths[w] += paths[v]
                            parents[w].append(v)
                share = defaultdict(float)
                for w in reversed(order):
                    for v in parents[w]:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != source:
                        total[w] += share[w]
        yield pd.DataFrame({"node": list(total), "part": list(total.values())})

    n = len(graph)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    every = nodes(edges)
    parts = every.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "node long, part double").groupBy("node").agg(F.sum("part").alias("p"))
    return every.join(parts, "node", "left").select("node", (F.coalesce("p", F.lit(0.0)) * scale).alias("betweenness"))


def louvain(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, community (its smallest node): one level of greedy modularity moves, nodes in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adj = _adjacency(pdf)
        strength = {v: sum(ns.values()) for v, ns in adj.items()}
        m2 = sum(strength.values()) or 1.0
        where, mass = {v: v for v in adj}, dict(strength)
        for _ in range(rounds):
            moved = False
            for v in sorted(adj):
                links = defaultdict(float)
                for u, w in adj[v].items():
                    links[where[u]] += w
                own = where[v]
                mass[own] -= strength[v]
                gain = lambda c: links.get(c, 0.0) - strength[v] * mass[c] / m2  # noqa: B023, E731
                best = max(sorted({own, *links}), key=lambda c: (gain(c), c == own))
                if gain(best) > gain(own) + 1e-12:
                    moved = True
                else:
                    best = own
                where[v] = best
                mass[best] += strength[v]
            if not moved:
                break
        least = {}
        for v, c in where.items():
            least[c] = min(least.get(c, v), v)
        return pd.DataFrame({"node": list(where), "community": [least[c] for c in where.values()]})

    one = _whole(edges).withColumn("g", F.lit(1))
    return one.groupBy("g").applyInPandas(run, "node long, community long")


def cliques(edges: DataFrame, least: int = 3) -> DataFrame:
    """clique (sorted array): all maximal cliques of at least `least` nodes; Bron-Kerbosch with pivots."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adj, out = {v: set(ns) for v, ns in _adjacency(pdf).items()}, []
        stack = [(set(), set(adj), set())]
        while stack:
            r, p, x = stack.pop()
            if not p and not x:
                if len(r) >= least:
                    out.append(sorted(r))
                continue
            pivot = max(p | x, key=lambda v: len(adj[v] & p))
            for v in sorted(p - adj[pivot]):
                stack.append((r | {v}, p & adj[v], x & adj[v]))
                p = p - {v}
                x = x | {v}
        return pd.DataFrame({"clique": out})

    one = _whole(edges).withColumn("g", F.lit(1))
    return one.groupBy("g").applyInPandas(run, "clique array<long>")


def traverse(edges: DataFrame, start, depth: int, strategy: str = "bfs") -> DataFrame:
    """GRAPH_TRAVERSE: the set of reached nodes."""
    name = strategy.lower()
    if name in ("bfs", "dfs", "parallel"):
        return bfs(edges, start, depth).select("node")
    if name == "bidirectional":
        return bidirectional(edges, start, depth).select("node")
    if name == "dijkstra":
        return dijkstra_reach(edges, start, depth).select("node")
    raise ValueError(strategy)


# -- ranking
def enhanced_rank(scored: DataFrame, edges: DataFrame, communities: DataFrame, focus) -> DataFrame:
    """node, score: 0.5 semantic + 0.3 degree / largest degree + 0.2 if in the focus node's community."""
    deg = degree(edges).select("node", "degree")
    top = deg.agg(F.max("degree").alias("top"))
    home = communities.where(F.col("node") == F.lit(focus)).select(F.col("community").alias("home"))
    rows = scored.join(deg, "node", "left").join(communities, "node", "left").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(home))  # one row each
    score = 0.5 * F.col("semantic") + 0.3 * F.coalesce(F.col("degree") / F.col("top"), F.lit(0.0)) + 0.2 * F.coalesce((F.col("community") == F.col("home")).cast("double"), F.lit(0.0))
    return rows.select("node", score.alias("score"))


def multi_hop_boost(scored: DataFrame, edges: DataFrame, focus, hops: int = 3) -> DataFrame:
    """semantic x (1 + (hops - d) 0.1), at most 1, for nodes within `hops`."""
    near = bfs(edges, focus, hops)
    boosted = F.least(F.lit(1.0), F.col("semantic") * (1 + (hops - F.col("depth")) * 0.1))
    return scored.join(near, "node", "left").select("node", F.coalesce(boosted, "semantic").alias("score"))


def temporal_rank(df: DataFrame, semantic: str, age_days: str, frequency: str):
    """Half semantic, half 0.3 recency (over 30 days) + 0.2 frequency (over 10)."""
    recent = F.greatest(F.lit(0.0), 1 - F.col(age_days) / 30.0)
    often = F.least(F.lit(1.0), F.col(frequency) / 10.0)
    return df.withColumn("score", 0.5 * F.col(semantic) + 0.5 * (0.3 * recent + 0.2 * often))


def graph_rag(embeddings: DataFrame, query: list[float], limit: int = 10, min_score: float | None = None, top_k: int | None = None, edges: DataFrame | None = None) -> DataFrame:
    """node_id, score, context: nearest nodes by cosine, boosted by the graph around the best one when edges are given."""
    from .vectors import top_k as nearest

    found = nearest(embeddings, query, top_k or max(2 * limit, 10), id_col="node_id")
    scored = found.select(F.col("node_id").alias("node"), (1 - F.col("distance")).alias("semantic"))
    if edges is not None and (best := scored.orderBy(F.desc("semantic"), "node").first()):
        scored = multi_hop_boost(scored, edges, best.node)
    else:
        scored = scored.select("node", F.col("semantic").alias("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") > min_score)
    context = F.concat(F.lit("node "), F.col("node").cast("string"))
    rows = scored.select(F.col("node").alias("node_id"), "score", context.alias("context"))
    return rows.orderBy(F.desc("score"), "node_id").limit(limit)


def with_rank(df: DataFrame, score: str = "score", tie: str = "node") -> DataFrame:
    """A rank column over a result whose size is a top-k."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), tie)))
