"""Near copies: SimHash finds candidates, the shingles decide, one text of each group stays.

*Link.* Two texts are linked if the Jaccard similarity of their five-word shingles is at
least 0.8 and one of their fingerprints is within 4 bits. A changed word changes one of a
text's words but five of its shingles, so the fingerprints are those of the set of single
words; four of them, from independent bits, because one alone misses near half
of the pairs of similarity 0.8 (two random planes out of 64 more or fewer decide).

*Group.* Texts that links connect. The row with the smallest id stays (null ids last, then the
order of the rows); copies of one text, by its lower-cased words, need no link.

*Search.* ``simhash.search`` over all four fingerprints at once: generalised pigeonhole with
unequal thresholds. Its pairs are verified one by one. First by what a text's mark says: the size of its
set, the fingerprints, and 512 bits, one of them set for each shingle; a bit that only one of two texts has is a
shingle that the other lacks, so a pair that the marks rule out is no link. Only pairs that pass carry their shingle sets.

*Dense groups.* What shares a crowded signature would give all pairs of a group. Those
texts meet through their shingles instead: texts of similarity s share one of their first
n - ceil(s n) + 1 shingles (tokens) in any fixed order; here by the count of a shingle's hash
bucket, rare ones first, so that a passage common to unlike texts is no token as a rule. In a round
all texts of a token that are not yet in one group meet its first k texts (k = 1, 16, 256, ...), if the marks allow it;
links found are contracted before the next round. A token is done if its texts are in
one group or all of them have met, so no link between groups is lost, and a group
of n near copies costs a few times n comparisons, not n * n.

Candidates and what goes are broadcast only if they are at most ``most_rows`` (counted first), so that
texts need not be shuffled to meet them; beyond that they are. docs is read three times and not copied: a row is found again by its
id and its text's hash. Where rows are alike in both, the first of them stays, if any.

Defined results: null and empty texts are copies of one another. A text of fewer than
five words is one shingle. Repeated rows are copies. An empty table gives an empty table. All
columns come back as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import slices
from .components import components
from .names import counted, fresh
from ..scratch import materialize, temporary
from .simhash import search, shingle_hashes

#: Buckets in which shingles are counted to order them; they steer cost only.
HEAT = 4096
#: Pairs (16 bytes each) up to which they are broadcast to the sets, so that those are shuffled once and not twice.
MOST_PAIRS = 1_000_000
#: Bits of a set's mark, in longs.
MARKS = [f"m{k}" for k in range(8)]
#: The step and the two mixing rounds of the SplitMix64 generator.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)))


def word_fingerprints(words: Iterable[bytes], count: int) -> np.ndarray:
    """`count` fingerprints (1 to 4) of a set of words. The first has the words' own hashes, the others mix those anew."""
    words = set(words)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))[:, None]
    more = hashes + np.arange(1, count, dtype=np.uint64) * _STEP
    for shift, factor in _MIX:
        more = (more ^ (more >> shift)) * factor
    bits = np.concatenate([hashes, more ^ (more >> np.uint64(31))], 1).view(np.uint8)
    total = np.zeros(64 * count, np.int64)
    for at in range(0, len(bits), 255):  # eight counts to a number, each below 256
        total += np.unpackbits(bits[at : at + 255], axis=1, bitorder="little").view(np.uint64).sum(0).view(np.uint8)
    return np.packbits(total * 2 > len(bits), bitorder="little").view("<u8")


def _fingerprinted(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """ord, same, rid, t -> ord, same, rid, the fingerprints, th (hash of the lower-cased words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                fps, ths = np.zeros((part.num_rows, len(columns)), np.uint64), np.zeros(part.num_rows, np.uint64)
                for i, text in enumerate(part.column(3).to_pylist()):
                    words = (text or b"").lower().split()
                    fps[i], ths[i] = word_fingerprints(words, len(columns)), xxhash.xxh64_intdigest(b" ".join(words), 7)
                cols = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (*fps.T, ths)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *cols], ["ord", "same", "rid", *columns, "th"])

    return keyed.mapInArrow(run, ", ".join(f"{c} long" for c in ("ord", "same", "rid", *columns, "th")))


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """rid, t -> rid, set of shingle hashes, n (its size), the mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                own = [np.unique(shingle_hashes(t, width)) for t in part.column(1).to_pylist()]
                bits = np.zeros((len(own), 64 * len(MARKS)), np.uint8)
                for i, x in enumerate(own):
                    bits[i, (x % np.uint64(64 * len(MARKS))).astype(np.int64)] = 1
                marks = np.packbits(bits, axis=1).view(np.int64)
                sets = pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))
                sizes = pa.array([len(x) for x in own], pa.int64())
                cols = [part.column(0), sets, sizes, *[pa.array(np.ascontiguousarray(x)) for x in marks.T]]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "set", "n", *MARKS])

    return texts.mapInArrow(run, "rid long, set array<long>, n long, " + ", ".join(f"{m} long" for m in MARKS))


def _enough(common: Column, n_a: Column, n_b: Column, similarity: float) -> Column:
    return common + 1e-9 >= similarity * (n_a + n_b - common)


def _may_link(a: str, b: str, columns: list[str], max_bits: int, similarity: float) -> Column:
    """Whether fingerprints, sizes and marks of two texts (columns with the prefixes a and b) allow a link."""
    apart = [F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) for c in columns]
    near = F.least(*apart) <= max_bits if len(apart) > 1 else apart[0] <= max_bits
    alone = lambda x, y: sum(F.bit_count(F.col(x + m).bitwiseAND(F.bitwise_not(F.col(y + m)))) for m in MARKS)
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    return near & _enough(F.least(n_a - alone(a, b), n_b - alone(b, a)), n_a, n_b, similarity)


def _possible(pairs: DataFrame, sets: DataFrame, columns: list[str], max_bits: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that their marks allow."""
    for side in ("a", "b"):
        own = [F.col(c).alias(f"{side}_{c}") for c in ("n", *columns, *MARKS)]
        few = counted(pairs, MOST_PAIRS) if side == "a" else pairs
        pairs = sets.select(F.col("rid").alias(side), *own).join(few, side)
    return pairs.where(_may_link("a_", "b_", columns, max_bits, similarity)).select("a", "b")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets are similar. pairs is a written table."""
    few = counted(pairs, MOST_PAIRS)
    second = sets.join(counted(pairs.select(F.col("b").alias("rid")).distinct(), MOST_PAIRS), "rid", "left_semi")
    first = sets.select(F.col("rid").alias("a"), F.col("set").alias("a_set")).join(few, "a")
    both = first.join(second.select(F.col("rid").alias("b"), F.col("set").alias("b_set")), "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    return both.where(_enough(common, F.size("a_set"), F.size("b_set"), similarity)).select("a", "b")


def _tokens(sets: DataFrame, similarity: float) -> DataFrame:
    """token, rid, rest: the shingles of which similar texts share one; rest is what is left of the set from the token on."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(HEAT, np.int64)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            total += np.bincount((values % np.uint64(HEAT)).astype(np.int64), minlength=HEAT)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    heat = np.zeros(HEAT, np.int64)
    for r in sets.select("set").mapInArrow(counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        heat[r.bucket] = r.n

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = own.values.to_numpy(zero_copy_only=False)
                wide = values.view(np.uint64)
                most = len(values) - int(np.ceil(similarity * len(values) - 1e-9)) + 1
                took = values[np.lexsort((wide, heat[(wide % np.uint64(HEAT)).astype(np.int64)]))[:most]]
                cols = [took, np.full(len(took), rid, np.int64), len(values) - np.arange(len(took))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["token", "rid", "rest"])

    return sets.where(F.size("set") > 0).select("rid", "set").mapInArrow(first, "token long, rid long, rest long")


def _dense_links(dense: DataFrame, links: DataFrame, columns: list[str], max_bits: int, similarity: float) -> DataFrame:
    """links, contracted, and links among texts of crowded signatures that connect all that theirs connect."""
    known = materialize(components(links), "near-known")
    links = known.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    live = _tokens(dense, similarity).join(known, F.col("rid") == F.col("node"), "left")
    live = live.select("token", "rid", "rest", F.coalesce("root", "rid").alias("label"))
    about = ["n", *columns, *MARKS]
    done, k = 0, 1
    while True:
        open_ = live.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("held"))
        live = live.join(open_.where((F.col("lo") < F.col("hi")) & (F.col("held") > done)).select("token", "held"), "token")
        if done == 0:  # only what is open carries its mark
            live = live.join(dense.select("rid", *about), "rid")
        live = materialize(live, "near-live")
        if live.isEmpty():
            break
        nth = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("rid"), "rid"))
        heads = live.withColumn("nth", nth).where(F.col("nth") <= k).where(F.col("nth") > done)
        heads = heads.select(F.col("token").alias("of"), *[F.col(c).alias(f"head_{c}") for c in ("rid", "rest", "label", *about)])
        # In the first token that two texts share, what they have in common is still to come: no more than the lesser rest.
        fits = (F.col("label") != F.col("head_label")) & _enough(F.least("rest", "head_rest"), F.col("n"), F.col("head_n"), similarity)
        met = live.join(heads, (F.col("token") == F.col("of")) & fits & _may_link("", "head_", columns, max_bits, similarity))
        met = met.select(F.least("rid", "head_rid").alias("a"), F.greatest("rid", "head_rid").alias("b")).distinct()
        new = materialize(_alike(materialize(met, "near-met"), dense, similarity), "near-links")
        if not new.isEmpty():
            links = links.union(new)
            label = live.select("rid", "label").distinct()
            one = label.select(F.col("rid").alias("a"), F.col("label").alias("la"))
            two = label.select(F.col("rid").alias("b"), F.col("label").alias("lb"))
            joined = new.join(one, "a").join(two, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
            moved = materialize(components(joined), "near-moved")
            live = live.where(F.col("held") > k).join(moved, F.col("label") == F.col("node"), "left").withColumn("label", F.coalesce("root", "label"))
        live = live.select("token", "rid", "rest", "label", *about)
        done, k = k, 16 * k
    return links


def drop_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    fingerprints: int = 4,
    max_bits: int = 4,
    verify_width: int = 5,
    similarity: float = 0.8,
    crowd: int = 256,
    most_rows: int = 1_000_000,
) -> DataFrame:
    """The documents that stay, one of each group of near copies, with the columns of docs. See the module's docstring."""
    columns = [f"f{k}" for k in range(fingerprints)]
    text = F.col(f"`{text_col}`").cast("string")
    order = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(2**63 - 1))
    with temporary(docs.sparkSession):
        keyed = docs.select(order.alias("ord"), F.xxhash64(text).alias("same"), F.monotonically_increasing_id().alias("rid"), text.cast("binary").alias("t"))
        rows = materialize(_fingerprinted(keyed, columns), "near-rows")
        twice = rows.groupBy("ord", "same").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
        twice = materialize(twice, "near-twice")
        repeated = not twice.isEmpty()
        texts = rows.groupBy(*columns, "th").agg(F.min(F.struct("ord", "rid", "same")).alias("first"))
        texts = materialize(texts.select("first.ord", "first.same", "first.rid", *columns), "near-texts")
        pairs, inside = search(texts.select(F.col("rid").alias("id"), *columns), columns, max_bits, crowd, per_candidate=0.02)
        pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
        some = pairs.select(F.col("a").alias("rid")).union(pairs.select("b"))
        if inside is not None:
            inside = inside.withColumnRenamed("id", "rid")
            some = some.union(inside)
        some = materialize(texts.join(some.distinct(), "rid", "left_semi").select("ord", "same", "rid", *columns), "near-some")
        wanted = keyed.select("ord", "same", "t").join(counted(some.select("ord", "same", "rid"), most_rows), ["ord", "same"])
        if repeated:
            wanted = wanted.join(counted(twice, most_rows), ["ord", "same"], "left").select("rid", "t", F.col("held").isNotNull().alias("more"))
            wanted = wanted.where("NOT more").select("rid", "t").union(wanted.where("more").groupBy("rid").agg(F.first("t").alias("t")))
        sets = _shingle_sets(wanted.select("rid", "t"), verify_width).join(counted(some.select("rid", *columns), most_rows), "rid")
        sets = materialize(sets, "near-sets")
        possible = materialize(_possible(pairs, sets, columns, max_bits, similarity), "near-possible")
        links = materialize(_alike(possible, sets, similarity), "near-links")
        if inside is not None:
            dense = sets.join(counted(inside, most_rows), "rid", "left_semi")
            links = _dense_links(dense, links, columns, max_bits, similarity)
        roots = materialize(components(links), "near-roots")
        member = roots.join(texts.select("rid", "ord", "same"), F.col("node") == F.col("rid")).select("root", "rid", "ord", "same")
        first = member.groupBy("root").agg(F.min(F.struct("ord", "rid")).alias("first")).select(F.col("first.rid").alias("rid"))
        gone = rows.join(texts, "rid", "left_anti").select("ord", "same").union(member.join(first, "rid", "left_anti").select("ord", "same"))
        gone = gone.groupBy("ord", "same").agg(F.count(F.lit(1)).alias("went")).join(counted(twice, most_rows), ["ord", "same"], "left")
        k_ord, k_same, one, seq, whole = (fresh(docs, x) for x in ("ord", "same", "one", "seq", "whole"))
        gone = gone.select(F.col("ord").alias(k_ord), F.col("same").alias(k_same), (F.coalesce("held", F.lit(1)) > F.col("went")).alias(one))
        gone = materialize(gone, "near-gone", keep=True)
    back = (order == F.col(k_ord)) & (F.xxhash64(text) == F.col(k_same))
    stay = docs.join(counted(gone, most_rows), back, "left_anti")
    alike = gone.where(F.col(one))
    if repeated and not alike.isEmpty():
        numbered = docs.withColumn(seq, F.monotonically_increasing_id()).join(counted(alike, most_rows), back)
        firsts = numbered.groupBy(k_ord, k_same).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), seq).alias(whole))
        stay = stay.union(firsts.select(f"{whole}.*"))
    return stay
