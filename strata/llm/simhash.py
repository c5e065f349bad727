"""SimHash near-dedup: fingerprints, and links by the generalised pigeonhole principle.

*Fingerprint.* A bit is 1 if it is set in over half of the hashes of a text's
word shingles. Documents with one fingerprint form one class, and only classes are searched.

*Search.* The 64 bits are grouped into m partitions, bits that go together (by
their correlation over all classes) into one. A pair within ``max_bits`` bits must, for any
thresholds t_1..t_m with sum(t_i + 1) = max_bits + 1, differ in at most t_i
bits in some partition i (t_i = -1 leaves the partition out). Each fingerprint
gets its own unequal thresholds: a dynamic program over the partitions takes those with the fewest
signatures plus estimated candidates. The estimates come from exact histograms
of 8-bit blocks over all classes (a few thousand numbers), convolved under
independence of the blocks; they steer cost only and never the result. m itself is chosen from
the same estimates, so the signatures get longer as the table grows.
Fingerprints are indexed by every partition's value, probed by all signatures
within their thresholds, and every candidate is verified by its bit count (``search``).

*Crowded signatures.* A signature that more than ``crowd`` classes share would
emit all pairs of a dense group. It is taken out of the index, and every class
that holds or probes it goes another exact way: it names all points within
max_bits / 2 bits of itself. Two fingerprints are within max_bits bits exactly if
they name a common point (max_bits is even). Each class takes the smallest class among its points as label and links to it;
then each point links the labels that meet there to the smallest of them. The components are
the same, and the links are about as many as the classes.

*Components* come from star rounds (see components.py); no links or
fingerprints reach the driver.

Defined results: null and empty texts have fingerprint zero, linked like any
other. A row with a null id belongs to its component but never names it; a
component of null ids has a null name. Repeated rows come back as often as they
came. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import slices
from .components import components
from ..scratch import materialize

BITS = 64
_ONE = np.uint64(1)


def shingle_bytes(text: bytes | None, width: int) -> list[bytes]:
    """Lower-cased (A-Z) word shingles in order, repeats included; the whole sequence if there are fewer words."""
    words = (text or b"").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    if width == 1:
        return words
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return [whole[s:e] for s, e in zip(starts, ends[width - 1 :].tolist(), strict=False)]


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, seed) for x in shingle_bytes(text, width)], np.uint64)


def fingerprint(hashes: np.ndarray, chunk: int = 1 << 15) -> int:
    """Bits set in over half of the hashes; zero if there are none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), chunk):
        part = np.ascontiguousarray(hashes[at : at + chunk], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text", width: int = 3) -> DataFrame:
    """keys and fp (signed 64 bits): one row per input row."""
    rows = docs.select(*keys, F.col(f"`{text_col}`").cast("string").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(keys)):
                fps = np.array([fingerprint(shingle_hashes(t, width)) for t in part.column(len(keys)).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(fps.view(np.int64))], [*keys, "fp"])

    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, fp long")


class Layout:
    """Bits grouped into partitions, partitions into blocks, and what the blocks' histograms say."""

    def __init__(self, groups: list[list[int]]):
        self.groups = groups
        self.blocks: list[tuple[int, list[int]]] = []
        for i, bits in enumerate(groups):
            parts = -(-len(bits) // 8)
            self.blocks += [(i, [int(b) for b in x]) for x in np.array_split(bits, parts)]
        self.near: list[np.ndarray] = []
        self.rows = 0

    def values(self, fps: np.ndarray, bits: list[int]) -> np.ndarray:
        out = np.zeros(len(fps), np.uint64)
        for place, bit in enumerate(bits):
            out |= ((fps >> np.uint64(bit)) & _ONE) << np.uint64(place)
        return out

    def learn(self, counts: dict[tuple[int, int], int], rows: int, most: int) -> None:
        """near[block][v, d]: the share of classes whose block differs from v in d bits."""
        self.rows = rows
        for b, (_, bits) in enumerate(self.blocks):
            size = 1 << len(bits)
            share = np.zeros(size)
            for v in range(size):
                share[v] = counts.get((b, v), 0) / max(1, rows)
            apart = np.bitwise_count(np.arange(size)[:, None] ^ np.arange(size)[None, :])
            self.near.append(np.stack([np.where(apart == d, share[None, :], 0).sum(1) for d in range(most + 1)], 1))

    def estimates(self, fps: np.ndarray | None, most: int) -> list[np.ndarray]:
        """Per partition: [row, t] candidates within t bits; a mean row if fps is None."""
        out: list[np.ndarray | None] = [None] * len(self.groups)
        for near, (i, bits) in zip(self.near, self.blocks, strict=True):
            own = near[self.values(fps, bits).astype(np.int64)] if fps is not None else (near[:, :1] * near).sum(0, keepdims=True)
            if out[i] is None:
                out[i] = own
            else:
                both = np.zeros_like(own)
                for d in range(most + 1):
                    for e in range(most + 1 - d):
                        both[:, d + e] += out[i][:, d] * own[:, e]
                out[i] = both
        return [np.cumsum(x, 1) * self.rows for x in out]

    def thresholds(self, fps: np.ndarray | None, most: int, per_candidate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
        """The dynamic program: per row the thresholds (-1: partition left out) and their cost."""
        estimates = self.estimates(fps, most)
        rows, total = len(estimates[0]), most + 1
        best = np.full((rows, total + 1), np.inf)
        best[:, 0] = 0
        back = []
        for bits, near in zip(self.groups, estimates, strict=True):
            nxt, took = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
            for use in range(total + 1):
                cost = 0 if use == 0 else radius_size(len(bits), use - 1) + per_candidate * near[:, use - 1]
                for s in range(total + 1 - use):
                    tried = best[:, s] + cost
                    better = tried < nxt[:, s + use]
                    nxt[better, s + use] = tried[better]
                    took[better, s + use] = use
            best = nxt
            back.append(took)
        left, picked = np.full(rows, total), np.zeros((rows, len(self.groups)), np.int8)
        for i in range(len(self.groups) - 1, -1, -1):
            picked[:, i] = back[i][np.arange(rows), left]
            left = left - picked[:, i]
        return picked - 1, best[:, total]


def radius_size(bits: int, radius: int) -> int:
    size = term = 1
    for d in range(1, radius + 1):
        term = term * (bits - d + 1) // d
        size += term
    return size


def radius_masks(bits: int, radius: int) -> np.ndarray:
    """All numbers of `bits` bits with at most `radius` bits set."""
    return np.array([sum(1 << b for b in c) for d in range(radius + 1) for c in combinations(range(bits), d)], np.uint64)


def group_bits(together: np.ndarray, rows: int, parts: int) -> list[list[int]]:
    """Bits into `parts` groups of even size; each grows by the bit most correlated with what it holds."""
    p = np.diag(together) / max(1, rows)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(1, rows) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = list(range(BITS)), []
    for i in range(parts):
        size = len(free) // (parts - i)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            nxt = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            free.remove(nxt)
        groups.append(sorted(group))
    return groups


def _longs(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _flags(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)


def _rows_batch(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray, dense: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in (keys, ids, fps)], pa.array(dense)], ["key", "id", "fp", "dense"])


def plan_layouts(rows: DataFrame, columns: list[str], max_bits: int, count: int, per_candidate: float = 0.5) -> list[Layout]:
    """Per column of fingerprints: statistics over all rows, then the layout with the least estimated cost."""

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(columns), BITS, BITS), np.int64)
        for batch in batches:
            for c in range(len(columns)):
                bits = np.unpackbits(_longs(batch, c).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total[c] += (bits.T @ bits).astype(np.int64)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*at, total[at])], ["c", "i", "j", "n"])

    seen = np.zeros((len(columns), BITS, BITS))
    for r in rows.select(*columns).mapInArrow(together, "c long, i long, j long, n long").groupBy("c", "i", "j").agg(F.sum("n").alias("n")).collect():
        seen[r.c, r.i, r.j] = r.n
    parts = [m for m in range(2, max_bits + 3) if m <= 4]
    layouts = [(c, Layout(group_bits(seen[c], count, m))) for c in range(len(columns)) for m in parts]

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [[np.zeros(1 << len(bits), np.int64) for _, bits in x.blocks] for _, x in layouts]
        for batch in batches:
            for (c, x), own in zip(layouts, counts, strict=True):
                fps = _longs(batch, c)
                for (_, bits), n in zip(x.blocks, own, strict=True):
                    n += np.bincount(x.values(fps, bits).astype(np.int64), minlength=len(n))
        out = [(m, b, int(v), int(n[v])) for m, own in enumerate(counts) for b, n in enumerate(own) for v in np.nonzero(n)[0]]
        cols = [pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4
        yield pa.RecordBatch.from_arrays(cols, ["m", "b", "v", "n"])

    found = rows.select(*columns).mapInArrow(histograms, "m long, b long, v long, n long").groupBy("m", "b", "v").agg(F.sum("n").alias("n")).collect()
    for m, (_, layout) in enumerate(layouts):
        layout.learn({(r.b, r.v): r.n for r in found if r.m == m}, count, max_bits)
    cost = lambda x: float(x.thresholds(None, max_bits, per_candidate)[1][0]) + len(x.groups)
    return [min((x for own, x in layouts if own == c), key=cost) for c in range(len(columns))]


def search(rows: DataFrame, columns: list[str], max_bits: int, crowd: int = 64, per_candidate: float = 0.5) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of rows with some fingerprint within max_bits bits.

    rows has a long `id` and the columns of fingerprints. The first result holds pairs (a, b) of different ids, in one or both orders,
    each checked by its bits. A signature that more than `crowd` rows share gives no pairs: all rows that hold or probe it are
    in the second result (id; None if there are none). The first result lacks pairs of two of those, and no others.
    """
    layouts = plan_layouts(rows, columns, max_bits, rows.count(), per_candidate)
    sizes = {len(g) for x in layouts for g in x.groups}
    masks = {(n, r): radius_masks(n, r) for n in sizes for r in range(max_bits + 1) if radius_size(n, r) < 20_000}
    kind = "key long, id long, fp long, dense boolean"

    def part(c: int, i: int) -> np.uint64:
        return np.uint64(c << 36 | i << 32)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _longs(batch, 0)
            for c, layout in enumerate(layouts):
                fps = _longs(batch, c + 1)
                keys = [layout.values(fps, g) | part(c, i) for i, g in enumerate(layout.groups)]
                yield _rows_batch(np.concatenate(keys), np.tile(ids, len(keys)), np.tile(fps, len(keys)), np.tile(_flags(batch), len(keys)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                ids = _longs(some, 0)
                for c, layout in enumerate(layouts):
                    fps = _longs(some, c + 1)
                    allowed, _ = layout.thresholds(fps, max_bits, per_candidate)
                    for i, g in enumerate(layout.groups):
                        values = layout.values(fps, g) | part(c, i)
                        for r in range(max_bits + 1):
                            own = allowed[:, i] == r
                            if own.any():
                                flips = masks[len(g), r] if (len(g), r) in masks else radius_masks(len(g), r)
                                repeated = [np.repeat(x[own], len(flips)) for x in (ids, fps, _flags(some))]
                                yield _rows_batch((values[own][:, None] ^ flips[None, :]).ravel(), *repeated)

    rows = rows.select("id", *columns)
    held, probes = (rows.withColumn("dense", F.lit(False)).mapInArrow(f, kind) for f in (index, probe))
    crowded = materialize(held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("key"), "crowded")
    inside = None
    if not crowded.isEmpty():
        inside = materialize(held.union(probes).join(crowded, "key", "left_semi").select("id").distinct(), "dense")
        flagged = rows.join(inside.withColumn("dense", F.lit(True)), "id", "left").select(*rows.columns, F.coalesce("dense", F.lit(False)).alias("dense"))
        held, probes = (flagged.mapInArrow(f, kind) for f in (index, probe))
    # Spark sizes a mapInArrow by its input; a hint keeps what it multiplies from being broadcast.
    left, right = (x.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "fp", "dense")]) for x, side in ((probes, "a"), (held, "b")))
    near = (F.col("a_id") != F.col("b_id")) & ~(F.col("a_dense") & F.col("b_dense"))
    near &= F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= max_bits
    pairs = left.hint("merge").join(right, (left["key"] == right["key"]) & near).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return pairs, inside


def near_links(classes: DataFrame, max_bits: int, crowd: int = 64) -> DataFrame:
    """Different fingerprints (column fp) -> edges (a, b) whose components are those of all pairs within max_bits bits."""
    if max_bits % 2:
        raise ValueError("max_bits must be even")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(fp, label) -> (point, label) for every point within max_bits / 2 of fp."""
        flips = radius_masks(BITS, max_bits // 2)
        for batch in batches:
            every, labels = _longs(batch, 0), _longs(batch, 1)
            for at in range(0, len(every), 512):
                fps = every[at : at + 512]
                cols = [(fps[:, None] ^ flips[None, :]).ravel(), np.repeat(labels[at : at + 512], len(flips))]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in cols], ["key", "fp"])

    kind = "key long, fp long"
    links, inside = search(classes.select(F.col("fp").alias("id"), "fp"), ["fp"], max_bits, crowd)
    if inside is not None:
        inside = inside.withColumnRenamed("id", "fp")
        points = inside.select("fp", F.col("fp").alias("label")).mapInArrow(around, kind)
        first = points.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("key", "b")
        label = points.hint("merge").join(first, "key").groupBy("fp").agg(F.min("b").alias("label"))
        label = materialize(label, "crowd-labels")
        named = label.mapInArrow(around, kind).distinct()
        low = named.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("key", "b")
        across = named.hint("merge").join(low, "key").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
        meet = label.where("fp <> label").select(F.col("fp").alias("a"), F.col("label").alias("b")).union(across)
        links = links.union(meet)
    return links


def _classes(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("fp").agg(F.min("id").alias("rep")), "classes")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per input row. See the module's docstring."""
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    rows = materialize(with_fingerprints(keyed, ["id"], "t", width), "fingerprints")
    classes = _classes(rows)
    roots = materialize(components(near_links(classes, max_bits)), "roots")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
