"""Quality classifier: importance resampling with hashed n-gram models.

Two multinomial models over hashed unigrams and bigrams are counted: the target (labelled
documents of good quality) and the raw text (all documents). A document's log
weight is the sum over its n-grams of log p_target - log p_raw. A document is drawn
with its weight and without replacement by Gumbel top-k: independent Gumbel
noise (from a hash of seed, id and text) is added to each log weight, and the k largest stay.

Tokens are runs of word characters and runs of other signs, lower-cased.
The labelled rows used are bounded by ``max_labelled`` (the smallest seeded
hashes of their ids), which also bounds the broadcast; the raw model's counts cover all
documents. Counts meet per bucket on the executors; the driver gets
2 x ``buckets`` numbers whatever the input.

k is not fixed in advance: a cut on the log weight is set on the labelled rows
where it tells good from bad best (the share of bad rows below it less the share
of good rows below it); of all cuts within ``slack`` of the best it is the lowest, so
that doubtful documents stay. k is the number of documents above it. The k-th largest perturbed weight is found by
radix selection over 16 bits a pass; no sort and no rows on the driver.

Defined results: a null or empty text has no n-grams and weight 0 (it stays if
the cut lies below 0). Rows that repeat id and text share their noise and stay or go
together; ties at the last place all stay, so more than k rows may stay by those
ties. Rows without labels, or with null labels, only count for the raw model.
Without both good and bad labelled rows nothing is known, and everything stays.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import hash01, slices
from .names import counted, fresh
from ..scratch import materialize, temporary

TOKEN = re.compile(r"\w+|[^\w\s]+")


def ngram_buckets(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed unigrams and bigrams of all texts, and how many each text has."""
    lists = [TOKEN.findall(t.lower()) if t else [] for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = pa.array([x for own in lists for x in own], pa.string()).dictionary_encode()
    names = np.array([xxhash.xxh64_intdigest(x) for x in flat.dictionary.to_pylist()], np.uint64)
    words = names[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    doc = np.repeat(np.arange(len(lists)), counts)
    inside = doc[:-1] == doc[1:]
    grams = np.concatenate([words % np.uint64(buckets), (pairs[inside] >> np.uint64(20)) % np.uint64(buckets)]).astype(np.int64)
    return grams, np.concatenate([doc, doc[1:][inside]])


def _sortable(x: np.ndarray) -> np.ndarray:
    """Doubles as signed 64-bit integers of the same order."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))


def fit(docs: DataFrame, labelled: DataFrame, buckets: int, smoothing: float = 0.5) -> np.ndarray:
    """Log ratio per bucket. docs: id, t; labelled: id, good (bounded)."""
    rows = docs.join(F.broadcast(labelled), "id", "left").select("t", "good")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                grams, doc = ngram_buckets(part.column(0).to_pylist(), buckets)
                raw += np.bincount(grams, minlength=buckets)
                good = np.array([x == 1 for x in part.column(1).to_pylist()], bool)
                target += np.bincount(grams[good[doc]], minlength=buckets)
        at = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, raw[at], target[at])], ["b", "raw", "target"])

    sums = rows.mapInArrow(count, "b long, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(buckets, smoothing), np.full(buckets, smoothing)
    for r in sums.collect():
        raw[r.b] += r.raw
        target[r.b] += r.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def score(docs: DataFrame, ratio: np.ndarray, seed: int = 17) -> DataFrame:
    """docs: id, t and more -> the same without t, with log_weight and rank_key (weight plus noise, as a sortable number)."""
    extra = [c for c in docs.columns if c != "t"]
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    docs = docs.select("t", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in slices(batch, 0):
                texts = part.column(0).to_pylist()
                grams, doc = ngram_buckets(texts, len(table))
                weight = np.bincount(doc, table[grams], len(texts))
                ids = part.column(extra.index("id") + 1).to_pylist()
                noise = np.array([xxhash.xxh64_intdigest(f"{i}\n{t or ''}", seed) for i, t in zip(ids, texts, strict=True)], np.uint64)
                perturbed = weight - np.log(-np.log(hash01(noise)))
                cols = [part.column(i + 1) for i in range(len(extra))] + [pa.array(weight), pa.array(_sortable(perturbed))]
                yield pa.RecordBatch.from_arrays(cols, [*extra, "log_weight", "rank_key"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in extra) + ", log_weight double, rank_key long")


def best_cut(weights: np.ndarray, good: np.ndarray, slack: float = 0.01) -> float | None:
    """The lowest cut that tells good from bad within slack of the best; None without both kinds."""
    if not len(weights) or good.all() or not good.any():
        return None
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.concatenate([[0.0], np.cumsum(g / g.sum())])
    shut = np.concatenate([[0.0], np.cumsum(~g / (~g).sum())])
    steps = np.concatenate([[True], w[1:] > w[:-1], [True]])
    gain = np.where(steps, shut - lost, -np.inf)
    at = int(np.nonzero(gain >= gain.max() - slack)[0][0])
    if at == 0:
        return -np.inf
    return float((w[at - 1] + w[at]) / 2) if at < len(w) else np.inf


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a long column, by four counting passes of at most 65,536 groups each."""
    prefix = 0
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(F.col(column), shift) if shift == 48 else F.shiftright(F.col(column), shift).bitwiseAND(0xFFFF)
        own = rows if shift == 48 else rows.where(F.shiftright(F.col(column), shift + 16) == prefix)
        counts = sorted(((r.d, r.n) for r in own.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        for value, n in counts:
            if n >= k:
                prefix = value if shift == 48 else (prefix << 16) | value
                break
            k -= n
    return prefix


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1 << 16,
    max_labelled: int = 50_000,
    seed: int = 17,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: the columns id, row, log_weight, kept. `row` is docs' column row_col, if one is named."""
    named = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("good"))
    chosen = materialize(named.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max_labelled), "labelled")
    row = F.lit(None).cast("long") if row_col is None else F.col(f"`{row_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row.alias("row"), F.col(f"`{text_col}`").cast("string").alias("t"))
    ratio = fit(rows.select("id", "t"), chosen, buckets)
    scored = materialize(score(rows, ratio, seed), "scores")
    known = scored.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("log_weight").alias("w"), F.max("good").alias("good")).collect()
    cut = best_cut(np.array([r.w for r in known], float), np.array([r.good == 1 for r in known], bool))
    k = scored.count() if cut is None else scored.where(F.col("log_weight") >= F.lit(cut)).count()
    if k == 0:
        kept = F.lit(False)
    elif cut is None:
        kept = F.lit(True)
    else:
        kept = F.col("rank_key") >= F.lit(kth_largest(scored, "rank_key", k))
    return scored.select("id", "row", "log_weight", kept.alias("kept"))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 2_000_000, **options
) -> DataFrame:
    """The documents that the resampling keeps, with the columns of docs.

    The draw depends on id and text alone, so rows alike in both go or stay together, and docs need not be copied to number them.
    """
    own, gone_id, gone_th = fresh(docs, "row"), fresh(docs, "gone_id"), fresh(docs, "gone_th")
    doc_id, th = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    with temporary(docs.sparkSession):
        drawn = resample(docs.withColumn(own, th), labels, id_col, text_col, row_col=own, **options)
        out = drawn.where("NOT kept").select(F.col("id").alias(gone_id), F.col("row").alias(gone_th)).distinct()
        out = materialize(out, "rejected", keep=True)
    return docs.join(counted(out, most_rows), (th == F.col(gone_th)) & doc_id.eqNullSafe(F.col(gone_id)), "left_anti")
