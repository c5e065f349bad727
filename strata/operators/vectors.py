"""Vector search: exact blocks, an inverted-file index, quantizers.

Query sets are split in blocks of a fixed size, broadcast as one matrix each; every task
multiplies its rows by the block and keeps its own top k, so what is shuffled is
k rows per task and query, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as vec
from ..scratch import materialize

#: Queries in one block: bounds the broadcast (block x dimension doubles).
BLOCK = 4096


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))


def distances(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """rows x queries."""
    if metric == "dot":
        return -(rows @ queries.T)
    if metric == "cosine":
        scale = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 1 - (rows @ queries.T) / scale
        return np.where(scale == 0, 1.0, out)
    if metric == "l2":
        gap = (rows**2).sum(1)[:, None] - 2 * rows @ queries.T + (queries**2).sum(1)[None, :]
        return np.sqrt(np.maximum(gap, 0))
    raise ValueError(metric)


#: Rows multiplied with a block of queries at once: bounds a task's memory.
CHUNK = 512
_NO_ID = -(2**63)


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", col: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """query_id, id, distance, rank: the exact k nearest rows of every query (ties by id).

    Every query row counts, also those that share an id or have none; with exclude_self rows of the query's own id are left out.
    """
    spark = vectors.sparkSession
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id")
    rows = vectors.select(ids, F.col(col).alias("v"))
    asked = materialize(queries.select(F.monotonically_increasing_id().alias("q"), ids, F.col(col).alias("v")), "queries")
    blocks, parts = -(-asked.count() // BLOCK), []
    for b in range(blocks):  # equal shares by hash: no sort, and no query lies between two blocks
        block = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toPandas()
        if len(block):
            shared = spark.sparkContext.broadcast((block["q"].to_numpy(np.int64), block["id"].to_numpy(np.int64), _matrix(block["v"])))
            parts.append(rows.mapInPandas(_nearest(shared, k, metric, exclude_self), "q long, query_id long, id long, distance double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("q").orderBy("distance", "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return best.select(known("query_id"), known("id"), "distance", "rank")


def _nearest(shared, k: int, metric: str, exclude_self: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, ids, queries = shared.value
        best_d, best_i = np.full((0, len(ids)), 0.0), np.zeros((0, len(ids)), np.int64)
        for batch in batches:
            every, vectors = batch["id"].to_numpy(np.int64), batch["v"]
            for at in range(0, len(every), CHUNK):
                own = every[at : at + CHUNK]
                d = distances(_matrix(vectors.iloc[at : at + CHUNK]), queries, metric)
                if exclude_self:
                    d[(own[:, None] == ids[None, :]) & (own != _NO_ID)[:, None]] = np.inf
                if len(best_d) == k:  # only rows that are near enough for some query go on
                    close = (d <= best_d[-1][None, :]).any(1)
                    own, d = own[close], d[close]
                d, i = np.vstack([best_d, d]), np.vstack([best_i, np.repeat(own[:, None], len(ids), 1)])
                keep = np.lexsort((i, d), axis=0)[:k]
                best_d, best_i = np.take_along_axis(d, keep, 0), np.take_along_axis(i, keep, 0)
        if len(best_d):
            out = pd.DataFrame({"q": np.tile(numbers, len(best_d)), "query_id": np.tile(ids, len(best_d)), "id": best_i.ravel(), "distance": best_d.ravel()})
            yield out[np.isfinite(out["distance"])]

    return run


class IvfIndex:
    """Approximate search: centroids are fitted on a bounded seeded sample, every row is indexed.

    The cells of a query are its `probes` nearest centroids; within them the search is exact. Cells grow in number
    with the square root of the rows (16 to 4,096) unless given.
    """

    def __init__(self, vectors: DataFrame, cells: int | None = None, sample: int = 20_000, rounds: int = 8, seed: int = 7, id_col: str = "vec_id", col: str = "embedding"):
        self.id_col, self.col = id_col, col
        cells = cells or int(min(4096, max(16, vectors.count() ** 0.5)))
        picked = vectors.select(id_col, col).orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(sample).toPandas()
        data = _matrix(picked[col])
        rng = np.random.default_rng(seed)
        self.centres = data[rng.permutation(len(data))[: min(cells, len(data))]]
        for _ in range(rounds):
            near = distances(data, self.centres, "l2").argmin(1)
            self.centres = np.stack([data[near == c].mean(0) if (near == c).any() else self.centres[c] for c in range(len(self.centres))])
        self.rows = self._cells(vectors, 1)

    def save(self, path: str) -> None:
        """Centroids and indexed rows, as Parquet below path; rows of one cell lie together."""
        spark = self.rows.sparkSession
        centres = [(i, c.tolist()) for i, c in enumerate(self.centres)]
        spark.createDataFrame(centres, "cell int, v array<double>").coalesce(1).write.parquet(f"{path}/centres")
        self.rows.repartitionByRange("cell", "id").sortWithinPartitions("cell").write.parquet(f"{path}/rows")

    @classmethod
    def load(cls, spark, path: str, id_col: str = "vec_id", col: str = "embedding") -> IvfIndex:
        self = cls.__new__(cls)
        self.id_col, self.col = id_col, col
        self.centres = _matrix(spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()["v"])
        self.rows = spark.read.parquet(f"{path}/rows")
        return self

    def _cells(self, df: DataFrame, n: int) -> DataFrame:
        centres = df.sparkSession.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    near = np.argsort(distances(_matrix(b["v"]), centres.value, "l2"), axis=1, kind="stable")[:, :n]
                    yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), near.shape[1]), "v": np.repeat(b["v"].to_numpy(), near.shape[1]), "cell": near.ravel()})

        return df.select(F.col(self.id_col).alias("id"), F.col(self.col).alias("v")).mapInPandas(run, "id long, v array<float>, cell int")

    def search(self, queries: DataFrame, k: int, probes: int = 16, metric: str = "l2") -> DataFrame:
        """query_id, id, distance, rank."""
        asked = self._cells(queries, probes).select(F.col("id").alias("query_id"), F.col("v").alias("q"), "cell")
        pairs = self.rows.join(asked, "cell").where("id <> query_id")
        scored = pairs.select("query_id", "id", vec.METRICS[metric](F.col("v"), F.col("q")).alias("distance"))
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """ORDER BY distance LIMIT k for one query, with `distance`: Spark keeps k rows per task."""
    q = F.lit([float(x) for x in query])
    return df.withColumn("distance", vec.METRICS[metric](F.col(col), q)).orderBy("distance", id_col).limit(k)


def scalar_quantizer(df: DataFrame, col: str = "embedding") -> DataFrame:
    """One row: per dimension the least value and the scale to 0..255 (scale 0 for a constant dimension)."""
    long = df.select(F.posexplode(col).alias("d", "x")).groupBy("d").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
    scale = F.when(F.col("hi") > F.col("lo"), 255.0 / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    rows = F.array_sort(F.collect_list(F.struct("d", "lo", scale.alias("scale"))))
    return long.agg(rows.alias("q")).select(F.transform("q", lambda x: x["lo"]).alias("lo"), F.transform("q", lambda x: x["scale"]).alias("scale"))


def quantize(df: DataFrame, quantizer: DataFrame, col: str = "embedding") -> DataFrame:
    """Adds `codes`: array of 0..255. The quantizer is one row (an aggregate without keys)."""
    step = lambda x, i: F.least(F.greatest(F.floor((x.cast("double") - F.get("lo", i)) * F.get("scale", i) + 0.5), F.lit(0)), F.lit(255)).cast("int")
    return df.crossJoin(F.broadcast(quantizer)).withColumn("codes", F.transform(col, step)).drop("lo", "scale")


def binary_code(col: str = "embedding") -> Column:
    """Bits (v > 0) as an array of longs, 32 bits each, first value in the lowest bit."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(col) - 1) / 32).cast("int")), lambda w: F.aggregate(F.reverse(F.slice(col, w * 32 + 1, 32)), F.lit(0).cast("long"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
