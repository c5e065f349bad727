"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A tree of regions, racks and shards carries weights. Each row descends from the
root: at every level each child makes a weighted draw from the hash of the row's
key and the child's name, ``-ln(u) / weight``, and the smallest draw wins. A
child is chosen in proportion to its weight, and a weight that rises only moves
rows into that child's subtree, so movement is confined to subtrees whose
weights change. The draw depends on the key, the seed and the child's name
alone: no state, no shuffle.

``uniform_tree`` places shards in order: shards fill a rack, racks fill a
region. The shard that comes after full regions opens a region of its own, so
growing from 24 shards to 25 moves rows only into the new shard.

Slots number the rows of a shard without gaps. Each shard is cut into ``cuts``
hash ranges; the ranges' counts (at most shards x cuts small rows, which bounds
the broadcast) give each range its first slot, and a window numbers the rows of
one range. No task holds a whole shard.

Defined results: a null text has no bytes (size 8, CRC of nothing). A row with
a null key is placed by its text's hash. Rows that repeat a key share its shard and
take slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

#: region -> rack -> shard -> weight
Tree = dict[int, dict[int, dict[int, float]]]


def uniform_tree(shards: int, racks_per_region: int = 3, shards_per_rack: int = 4) -> Tree:
    """Shards 0..n-1 of weight 1, in order, in full racks and regions first."""
    tree: Tree = {}
    for shard in range(shards):
        rack = shard // shards_per_rack
        tree.setdefault(rack // racks_per_region, {}).setdefault(rack, {})[shard] = 1.0
    return tree


def _draw(key: Column, seed: int, level: str, name: int, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from the top 53 bits of a hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), F.lit(name), key), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**53))) / F.lit(float(weight))


def _choose(key: Column, seed: int, level: str, weights: dict[int, float]) -> Column:
    live = {n: w for n, w in weights.items() if w > 0}
    if len(live) == 1:
        return F.lit(next(iter(live)))
    draws = [F.struct(_draw(key, seed, level, n, w).alias("d"), F.lit(n).alias("n")) for n, w in sorted(live.items())]
    return F.array_min(F.array(*draws))["n"]


def shard_of(key: Column, tree: Tree, seed: int = 11) -> Column:
    """The shard that the key's descent reaches."""
    racks = {r: {k: sum(s.values()) for k, s in rs.items()} for r, rs in tree.items()}
    regions = {r: sum(ws.values()) for r, ws in racks.items()}

    def below_region(region: int) -> Column:
        rack = _choose(key, seed, "rack", racks[region])
        out = F.lit(None).cast("int")
        for k, shards in tree[region].items():
            if racks[region][k] > 0:
                out = F.when(rack == k, _choose(key, seed, "shard", shards)).otherwise(out)
        return out

    region = _choose(key, seed, "region", regions)
    out = F.lit(None).cast("int")
    for r in tree:
        if regions[r] > 0:
            out = F.when(region == r, below_region(r)).otherwise(out)
    return out


def assign_shards(
    docs: DataFrame,
    tree: Tree,
    grown: Tree | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 11,
    cuts: int = 1024,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per input row. See the module's docstring."""
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    key = F.coalesce(F.when(doc_id.isNotNull(), F.xxhash64(F.lit("id"), doc_id)), F.xxhash64(F.lit("text"), text))
    rows = docs.select(
        doc_id.alias("id"),
        key.alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("crc"),
    )
    rows = rows.select(
        "id",
        "size",
        "crc",
        shard_of(F.col("key"), tree, seed).alias("shard"),
        (shard_of(F.col("key"), grown, seed) if grown else F.lit(None).cast("int")).alias("grown"),
        # Rows without an id may be alike by the thousand; which of them has which slot does not matter.
        F.pmod(F.xxhash64(F.lit("slot"), "key", "crc", F.when(F.col("id").isNull(), F.monotonically_increasing_id())), F.lit(cuts)).cast("int").alias("cut"),
    )
    rows = materialize(rows, "shard-rows")
    counts = rows.groupBy("shard", "cut").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "cut").orderBy("id", "crc", "size")
    numbered = rows.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(first), ["shard", "cut"])
    return numbered.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        (F.col("first") + F.col("nth")).cast("long").alias("slot"),
        F.col("grown").alias("grown_shard"),
    )
