"""Every stage of the corpus pipeline against a brute-force version, on the smallest tables."""

import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import xxhash

from test_near_copies import brute_kept

FOLDER = "/root/testdata/sf0.001"
M64 = 2**64 - 1


def brute_quality(docs, labels, buckets=1 << 16, seed=17):
    """Positions that importance resampling draws."""

    def grams(text):
        names = [xxhash.xxh64_intdigest(x) for x in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
        pairs = [((a * 0x9E3779B97F4A7C15 & M64) ^ b) * 0xC2B2AE3D27D4EB4F & M64 for a, b in zip(names, names[1:], strict=False)]
        return [x % buckets for x in names] + [(x >> 20) % buckets for x in pairs]

    good = {}
    for r in labels:
        if r.quality is not None and r.doc_id is not None:
            good[r.doc_id] = max(r.quality, good.get(r.doc_id, 0))
    raw, target, own = Counter(), Counter(), [Counter(grams(r.text)) for r in docs]
    for r, c in zip(docs, own, strict=True):
        raw.update(c)
        if good.get(r.doc_id) == 1:
            target.update(c)
    all_raw, all_target = sum(raw.values()) + buckets / 2, sum(target.values()) + buckets / 2
    ratio = {g: math.log((target[g] + 0.5) / all_target) - math.log((raw[g] + 0.5) / all_raw) for g in raw}
    weight = [sum(n * ratio[g] for g, n in c.items()) for c in own]
    known = sorted((w, good[r.doc_id] == 1) for r, w in zip(docs, weight, strict=True) if r.doc_id in good)
    n_good = sum(g for _, g in known)
    cuts = [(-math.inf)] + [(a + b) / 2 for (a, _), (b, _) in zip(known, known[1:], strict=False) if b > a] + [math.inf]
    gain = lambda c: sum(w < c and not g for w, g in known) / (len(known) - n_good) - sum(w < c and g for w, g in known) / n_good
    top = max(map(gain, cuts))
    cut = next(c for c in cuts if gain(c) >= top - 0.01 - 1e-12)
    noise = [((xxhash.xxh64_intdigest(f"{r.doc_id}\n{r.text or ''}", seed) >> 11) + 0.5) / 2.0**53 for r in docs]
    perturbed = [w - math.log(-math.log(u)) for w, u in zip(weight, noise, strict=True)]
    k = sum(w >= cut for w in weight)
    least = sorted(perturbed, reverse=True)[k - 1]
    return [i for i, p in enumerate(perturbed) if p >= least]


def brute_clean(docs, items):
    """Positions of documents that hold no item."""

    def shingles(text):
        words = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    wanted = [s for s in map(shingles, items) if s]
    own = [shingles(r.text) for r in docs]
    return [i for i, s in enumerate(own) if not any(len(s & w) >= math.ceil(0.8 * len(w) - 1e-9) for w in wanted)]


def spark_hash(*values):
    """Spark's xxhash64 of strings, ints (4 bytes) and longs (tuples of one)."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(4, "little", signed=True) if isinstance(v, int) else v[0].to_bytes(8, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return h


def signed(x):
    return x - 2**64 if x >> 63 else x


def brute_shard(doc_id, shards, seed=11):
    """Regions of three racks of four shards; the smallest draw wins at each level."""
    key = (signed(spark_hash("id", (doc_id,))),)

    def choose(level, weights):
        if len(weights) == 1:
            return next(iter(weights))
        return min((-math.log(((spark_hash(seed, level, n, key) >> 11) + 0.5) / 2.0**53) / w, n) for n, w in weights.items())[1]

    region = choose("region", Counter(s // 12 for s in range(shards)))
    rack = choose("rack", Counter(s // 4 for s in range(shards) if s // 12 == region))
    return choose("shard", {s: 1 for s in range(shards) if s // 4 == rack})


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage, in order."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").coalesce(1)
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema).coalesce(1)
        out.append(docs.collect())
    return [*out, corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()]


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near duplicates", "benchmark decontamination", "mixing", "sharding"]


def test_quality(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    assert sorted(stages[1]) == sorted(stages[0][i] for i in brute_quality(stages[0], labels))
    assert 0 < len(stages[1]) < len(stages[0])


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    assert sorted(stages[2]) == sorted(stages[1][i] for i in brute_kept(rows))
    assert len(stages[2]) < len(stages[1])


def test_decontamination(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert sorted(stages[3]) == sorted(stages[2][i] for i in brute_clean(stages[2], items))


def test_mixing(spark, stages):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, given, longest = Counter(), Counter(), defaultdict(int)
    for r in stages[3]:
        size[r.source] += words(r.text)
        longest[r.source] = max(longest[r.source], words(r.text))
    for r in stages[4]:
        given[r.source] += words(r.text)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, live = {}, 1.5 * sum(size.values()), set(names)
    while live:  # sources that are full go first
        share = left / sum(weight[s] for s in live)
        full = {s for s in live if share * weight[s] >= 2 * size[s]}
        for s in full or live:
            target[s] = 2.0 * size[s] if full else share * weight[s]
        left -= sum(target[s] for s in full)
        live -= full or live
    for s in names:
        assert abs(given[s] - target[s]) <= longest[s] + 2, (s, given[s], target[s])
    before, after = Counter(stages[3]), Counter(stages[4])
    assert all(n <= 2 * before[r] for r, n in after.items())


def test_sharding(stages):
    out = stages[5]
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in stages[4])
    for r in out:
        assert r.law == "key" and r.shard == brute_shard(r.doc_id, 24) and r.grown_shard == brute_shard(r.doc_id, 25)
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.count() > 0 and {"doc_id", "shard", "slot", "grown_shard"} <= set(got.columns)
