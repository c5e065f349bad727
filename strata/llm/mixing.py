"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Sources take weights in turn by code point (null last) and share ``share`` times
all words; a source stops at ``most`` times its own words and what it leaves is
reshared by weight until none is above (water filling, solved in closed form by
windows over the sources).

The mix is dealt in blocks of equal words. One block is 2**-20 of all words, at
least 1 word and at most ``most_block``. The sources' targets get the blocks by highest quotients
(target / 1, / 3, / 5 ...). A divisor below and one above bracket the number of
blocks within one per source, so only the quotients between the two, at most
about two per source, are ranked. Each source is cut into shards of about
``shard_blocks`` blocks by the hash of id and text, and its blocks are apportioned to its
shards in the same way: an integer quota per shard. No shard takes more than ``most`` times its blocks; what one cannot take
goes to the source's next shards with room. What is held over all sources at once, by windows in one task,
is one row per source, and per source one row per shard (about a million words).

Within a shard, documents lie end to end in the order of a seeded hash. A quota
takes whole passes over the shard's blocks and then a seeded systematic draw of
the rest: of n blocks, r are chosen evenly from a seeded start. (The last block takes what is
left, up to half a block more or less.) What a document
gives is the overlap of its stretch with the chosen blocks, in closed form; no
block is ever a row.

Defined results: a null text has size 0; texts of size 0 give 0 and have no place in a shard (mix_shard and shard_quota are null). A null source is a source
(the last). Rows that repeat an id lie beside each other, each with its own
stretch. An empty table gives an empty result, and a table without words takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import fresh
from ..scratch import materialize

#: What counts as a word, for a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words in a text: places where a word begins, counted as what is left when each word becomes one character."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size -> with nth (order by code point, null last), weight, total and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    rows = sizes.withColumn("nth", nth)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = rows.withColumn("weight", F.element_at(cycle, (F.col("nth") % len(weights)) + 1))
    everything = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(everything))
    rows = rows.withColumn("full_at", F.lit(most) * F.col("source_size") / F.col("weight"))
    by_ratio = Window.orderBy("full_at", "nth")
    rows = rows.withColumn("filled", F.coalesce(F.sum(F.lit(most) * F.col("source_size")).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.lit(share) * F.col("total") - F.col("filled")) / F.col("open"))
    at = F.min(F.when(F.col("level") <= F.col("full_at") * (1 + 1e-12), F.struct("full_at", "nth", "level"))).over(everything)["level"]
    rows = rows.withColumn("at", F.coalesce(at, F.max("full_at").over(everything)))
    target = F.least(F.lit(most) * F.col("source_size"), F.col("at") * F.col("weight"))
    return rows.select("source", "source_size", "nth", "weight", "total", target.alias("target"))


def highest_quotients(rows: DataFrame, within: list[str], order: list[str], weight: str, seats: str) -> DataFrame:
    """rows with ``quota``: the seats of each group (``seats``, one number per group) apportioned to its rows by Sainte-Lague."""
    group = Window.partitionBy(*within)
    live = F.col(weight) > 0
    rows = rows.withColumn("__t", F.sum(F.col(weight).cast("double")).over(group)).withColumn("__n", F.count(F.when(live, 1)).over(group))
    room = F.col("__n") / 2 + 1
    few = F.col(seats) - room
    base = F.when(live & (few > 0), F.floor(F.col(weight) * few / F.col("__t") + 0.5)).otherwise(0).cast("long")
    upto = F.when(live, F.floor(F.col(weight) * (F.col(seats) + room) / F.col("__t") + 0.5)).otherwise(0).cast("long")
    rows = rows.withColumn("__base", base).withColumn("__upto", upto)
    rows = rows.withColumn("__left", F.col(seats) - F.sum("__base").over(group))
    between = F.when(F.col("__upto") > F.col("__base"), F.sequence(F.col("__base"), F.col("__upto") - 1))
    keys = [*within, *order]
    tried = rows.select(*keys, "__left", F.col(weight).alias("__w"), F.explode(between).alias("__k"))
    rank = Window.partitionBy(*within).orderBy(F.desc(F.col("__w") / (2 * F.col("__k") + 1)), *order, "__k")
    won = tried.withColumn("__rank", F.row_number().over(rank)).where("__rank <= __left").groupBy(*keys).agg(F.count(F.lit(1)).alias("__won"))
    out = rows.join(won, keys, "left").withColumn("quota", F.col("__base") + F.coalesce("__won", F.lit(0)))
    return out.drop("__t", "__n", "__base", "__upto", "__left", "__won")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    most_block: int = 256,
    shard_blocks: int = 4096,
    seed: int = 5,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, mix_shard, shard_quota, block: one row per input row."""
    base = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`").cast("string")).alias("size"),
        F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("th"),
    )
    base = materialize(base.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "mix-rows")
    sources = base.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    planned = source_targets(sources.select("source", "source_size"), weights, share, most)
    planned = planned.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    block = F.greatest(F.lit(1), F.least(F.lit(most_block), F.shiftright("total", 20))).cast("long")
    planned = planned.withColumn("block", block).withColumn("all", F.lit(1))
    planned = planned.withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / F.col("block")).cast("long"))
    planned = highest_quotients(planned, ["all"], ["nth"], "target", "blocks")
    planned = planned.withColumn("cuts", F.greatest(F.lit(1), F.ceil(F.col("source_size") / (F.col("block") * shard_blocks))).cast("long"))
    planned = materialize(planned.select("skey", "source_size", "target", "block", "cuts", F.col("quota").alias("seats")), "mix-sources")

    every = base.join(planned, "skey")
    rows = every.where("size > 0").withColumn("g", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "id", "th"), F.col("cuts")))
    shards = rows.groupBy("skey", "g", "seats", "block").agg(F.sum("size").alias("words"))
    quotas = highest_quotients(shards, ["skey"], ["g"], "words", "seats")
    quotas = quotas.select("skey", "g", "words", "quota", F.greatest(F.lit(1), F.round(F.col("words") / F.col("block"))).cast("long").alias("nb"))
    full = (F.lit(most) * F.col("nb")).cast("long")
    quotas = quotas.withColumn("room", F.greatest(full - F.col("quota"), F.lit(0))).withColumn("over", F.greatest(F.col("quota") - full, F.lit(0)))
    earlier = Window.partitionBy("skey").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("over").over(Window.partitionBy("skey")) - F.coalesce(F.sum("room").over(earlier), F.lit(0))
    quotas = quotas.withColumn("more", F.greatest(F.lit(0), F.least("room", left)))
    quotas = quotas.withColumn("quota", F.col("quota") - F.col("over") + F.col("more"))
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "skey", "g"), F.col("nb"))
    quotas = quotas.select("skey", "g", "quota", "nb", F.floor(F.col("quota") / F.col("nb")).alias("passes"), F.pmod("quota", "nb").alias("rest"), start.alias("start"))

    line = Window.partitionBy("skey", "g").orderBy(F.xxhash64(F.lit(seed), F.lit("line"), "id", "th"), "id", "th", "size")
    laid = rows.withColumn("upto", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).join(quotas, ["skey", "g"])

    def chosen_before(j: Column) -> Column:
        upto = F.floor((j + F.col("start")) * F.col("rest") / F.col("nb"))
        return upto - F.floor(F.col("start") * F.col("rest") / F.col("nb"))

    def given(x: Column) -> Column:
        """Words of the chosen blocks before place x."""
        j = F.least(F.floor(x / F.col("block")), F.col("nb") - 1)
        part = (chosen_before(j + 1) - chosen_before(j)) * (x - j * F.col("block"))
        return chosen_before(j) * F.col("block") + part

    taken = F.col("passes") * F.col("size") + given(F.col("upto")) - given(F.col("upto") - F.col("size"))
    place = ["id", "size", "source_size", "target", "source", "block", "th"]
    out = laid.select(*place, taken.cast("long").alias("taken"), "g", "quota")
    nothing = every.where("size = 0").select(*place, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("g"), F.lit(None).cast("long").alias("quota"))
    return out.union(nothing).select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        "taken",
        "source",
        F.col("g").alias("mix_shard"),
        F.col("quota").alias("shard_quota"),
        "block",
        F.col("th").alias("text_hash"),
    )


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5) -> DataFrame:
    """The mixed documents, with the columns of docs: each whole document taken / size times, without bias.

    A row comes floor(taken / size) times, and once more if the draw of the remainders falls on it: along each source's
    shard, in order of size, the fractions add up from a seeded start, and each whole number passed is one copy. In that
    order the words delivered differ from the words taken by at most the shard's largest document.
    Rows alike in id, source and text share their copies evenly.
    """
    skey = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    ikey = lambda c: F.coalesce(c.cast("string"), F.lit("n"))
    i, s, t, nth, times, alike, copy = (fresh(docs, x) for x in ("id", "source", "text_hash", "nth", "times", "alike", "copy"))
    rows = mixed.where("size > 0").select(
        ikey(F.col("doc_id")).alias(i), skey(F.col("source")).alias(s), F.col("text_hash").alias(t), "size", "taken", "mix_shard"
    )
    line = Window.partitionBy(s, "mix_shard").orderBy("size", F.xxhash64(F.lit(seed), F.lit("copy"), i, t), i, t, "taken")
    start = F.pmod(F.xxhash64(F.lit(seed), F.lit("copies"), s, "mix_shard"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    owed = F.sum(F.pmod("taken", "size") / F.col("size")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("passed", F.floor(owed + start))
    drawn = F.col("passed") - F.lag("passed", 1, 0).over(line)
    rows = rows.withColumn("copies", F.floor(F.col("taken") / F.col("size")) + drawn)
    keys = [i, s, t]
    shared = rows.groupBy(*keys).agg(F.sum("copies").alias(times), F.count(F.lit(1)).alias(alike)).where(F.col(times) > 0)
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.withColumns({i: ikey(F.col(f"`{id_col}`").cast("long")), s: skey(F.col(f"`{source_col}`").cast("string")), t: F.xxhash64(text)})
    keyed = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(i)))
    upto = lambda k: F.floor(F.col(times) * k / F.col(alike))
    copies = F.explode(F.array_repeat(F.lit(1), (upto(F.col(nth)) - upto(F.col(nth) - 1)).cast("int")))
    return keyed.join(shared, keys).withColumn(copy, copies).select(*[F.col(f"`{c}`") for c in docs.columns])
