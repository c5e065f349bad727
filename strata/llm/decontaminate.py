"""Benchmark decontamination by size-partitioned MinHash containment search, with DataFrame functions only.

Texts are sets of word shingles (``width`` words of letters and digits, lower-cased; a text with
fewer words is one shingle). An item is found in a document if at
least ``share`` of the item's shingles are the document's.

*Search.* MinHash banding estimates Jaccard similarity, and an item of 30 shingles inside a
document of 10,000 has a similarity near 0.003, where no banding has usable recall. The
containment form used here keeps min-hash order but loses nothing: items are partitioned by size (powers of two),
the partition's largest item sets the length of the sketch, u - ceil(share * u) + 1 for u shingles, and
an item's sketch is its so many smallest shingles in min-hash order (its bottom-k sketch; all, if it has fewer).
A document that holds at least need = ceil(share * n) of the item's n misses at most n - need, so of the k in its sketch it
holds at least k - (n - need): pairs with fewer hits are out, and so are documents with fewer shingles than
their partition's least item needs. A shingle that many items or documents hold costs hits where it stands, which are summed before
they are shuffled by (document, item); it is not a key of its own.
Documents' shingles are hashed in place (explode inside one code-generated stage) and meet
the signatures by hash.

*Verification.* The hit documents are read again, and their shingles are compared as strings with all
shingles of the items they were hit for.

Both item tables are broadcast only if they hold at most ``most_rows`` rows (counted first);
beyond that the same joins shuffle.

Defined results: a null or empty text has no shingles and is in no pair; so is such an item.
Items of equal words form one class, named by its smallest id. A document is known by
id and text: rows that repeat both count once in pairs and go together when dropped. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import counted, fresh
from ..scratch import materialize


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null if there are none."""
    plain = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain != "", F.split(plain, " "))


def _exploded(rows: DataFrame, width: int) -> DataFrame:
    """One row per shingle place: adds `at` (null words are dropped)."""
    last = F.greatest(F.size("words") - width, F.lit(0))
    return rows.where("words IS NOT NULL").withColumn("at", F.explode(F.sequence(F.lit(0), last)))


def _parts(width: int) -> list[Column]:
    return [F.get(F.col("words"), F.col("at") + i) for i in range(width)]


def signatures(items: DataFrame, share: float, width: int, seed: int = 3) -> DataFrame:
    """item, n, need, hash, shingle, nth (its place in the item), in_signature, least (hits in it): one row per item class and distinct shingle."""
    rows = items.select(F.col("item_id").cast("long").alias("id"), words_of(F.col("text").cast("string")).alias("words")).where("words IS NOT NULL")
    classes = rows.groupBy("words").agg(F.min("id").alias("item"))
    shingles = _exploded(classes, width).select("item", F.xxhash64(*_parts(width)).alias("hash"), F.concat_ws(" ", *_parts(width)).alias("shingle")).distinct()
    sizes = shingles.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    rows = shingles.join(sizes, "item").withColumn("need", F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)).cast("long"))
    order = Window.partitionBy("item").orderBy(F.xxhash64(F.lit(seed), "hash"), "shingle")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("part", F.floor(F.log2("n")).cast("int"))
    parts = rows.groupBy("part").agg(F.min("need").alias("part_need"), F.max(F.col("n") - F.col("need") + 1).alias("sketch"))
    rows = rows.join(parts, "part").withColumn("sketch", F.least("sketch", "n"))
    return rows.withColumn("in_signature", F.col("nth") <= F.col("sketch")).withColumn("least", F.col("sketch") - (F.col("n") - F.col("need")))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    share: float = 0.8,
    width: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_rows: int = 2_000_000,
) -> DataFrame:
    """doc_id, th (hash of the text), item_id, n_shingles, n_shared: one row per distinct document and item class found in it."""
    known = materialize(signatures(items, share, width), "signatures")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), words_of(text).alias("words"))

    signed = known.where("in_signature").select("hash", "item", "part_need", "least")
    probes = _exploded(rows, width).select("id", "th", F.greatest(F.size("words") - width + 1, F.lit(1)).alias("most"), F.xxhash64(*_parts(width)).alias("hash"))
    hits = probes.join(counted(signed, most_rows), "hash").where("most >= part_need")
    hits = hits.groupBy("id", "th", "item", "least").agg(F.count(F.lit(1)).alias("n")).where("n >= least").select("id", "th", "item")
    hits = materialize(hits, "hits")

    found = hits.select(F.col("id").alias("hit_id"), F.col("th").alias("hit_th")).distinct()
    of_hits = rows.join(counted(found, most_rows), F.expr("th = hit_th AND id <=> hit_id"), "left_semi")
    theirs = _exploded(of_hits, width).select("id", "th", F.xxhash64(*_parts(width)).alias("hash"), F.concat_ws(" ", *_parts(width)).alias("shingle"))
    shared = theirs.join(counted(known.select("hash", "shingle", "item", "nth", "n", "need"), most_rows), ["hash", "shingle"])
    totals = shared.select("id", "th", "item", "nth", "n", "need").distinct().groupBy("id", "th", "item", "n", "need").agg(F.count(F.lit(1)).alias("n_shared"))
    totals = totals.where("n_shared >= need")
    proved = totals.alias("c").join(hits.alias("h"), F.expr("c.th = h.th AND c.item = h.item AND c.id <=> h.id"), "left_semi")
    return proved.select(F.col("id").alias("doc_id"), "th", F.col("item").alias("item_id"), F.col("n").alias("n_shingles"), "n_shared")


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: one row per document id and item class."""
    found = contained_items(docs, items, **options)
    best = found.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_shared").alias("n_shared"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 2_000_000, **options) -> DataFrame:
    """The documents that hold no item, with the columns of docs."""
    found = contained_items(docs, items, id_col=id_col, text_col=text_col, most_rows=most_rows, **options)
    gone_id, gone_th = fresh(docs, "gone_id"), fresh(docs, "gone_th")
    gone = materialize(found.select(F.col("doc_id").alias(gone_id), F.col("th").alias(gone_th)).distinct(), "contaminated")
    same = (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(gone_th)) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(gone_id))
    return docs.join(counted(gone, most_rows), same, "left_anti")
