"""The near-copy stage against a brute-force reading of all pairs, and its recall."""

import random

import pytest
from strata.llm import near_copies

SCHEMA = "doc_id long, text string, rid long, __row long"


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similar(a, b):
    both = len(a & b)
    return both > 0 and 5 * both >= 4 * (len(a) + len(b) - both)


def fingerprints(text):
    return [int(x) for x in near_copies.word_fingerprints((text or "").lower().encode().split(), 4)]


def close(x, y):
    return any((p ^ q).bit_count() <= 4 for p, q in zip(x, y, strict=True))


def brute_kept(rows):
    """rows: (id, text) in order -> positions that stay."""
    texts = [" ".join((t or "").lower().split()) for _, t in rows]
    sets, fps = [shingles(t) for t in texts], [fingerprints(t) for t in texts]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if texts[i] == texts[j] or (similar(sets[i], sets[j]) and close(fps[i], fps[j])):
                group[find(i)] = find(j)
    best = {}
    for i, (key, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (2**63, 0)), (2**63 - 1 if key is None else key, i))
    return sorted(i for _, i in best.values())


def families(count, copies, words, seed):
    """Near copies of texts from one template: some words changed per family and per copy."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for f in range(count):
        own = list(base)
        for p in rng.sample(range(words), 3):
            own[p] = f"f{f}p{p}"
        for c in range(copies):
            text = list(own)
            for p in rng.sample(range(words), rng.randrange(4)):
                text[p] = f"c{c}p{p}"
            out.append(" ".join(text))
    return out


def drifting(count, seed):
    rng = random.Random(seed)
    words = [f"v{rng.randrange(10**6)}" for _ in range(250)]
    out = []
    for v in range(count):
        for p in rng.sample(range(250), 3):
            words[p] = f"d{v}p{p}"
        out.append(" ".join(words))
    return out


ODD = [None, "", " \t", "one", "One", "one two", "a b c d", "x " * 6000, "x " * 6001, "b a " * 50, "a b " * 50]


@pytest.mark.parametrize("crowd", [256, 3])
def test_kept_match_brute_force(spark, crowd):
    rng = random.Random(crowd)
    texts = families(8, 6, 120, 1) + drifting(30, 2) + families(1, 40, 60, 3) + ODD
    rows = list(zip(rng.sample(range(10**6), len(texts)), texts, strict=True))
    rows += [(rows[0][0], texts[0]), (None, texts[3]), (None, "only here " * 9), (None, "Only here " * 9)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, i, -i) for i, r in enumerate(rows)], SCHEMA).coalesce(1)
    got = near_copies.drop_near_duplicates(docs, crowd=crowd)
    assert got.columns == docs.columns
    kept = sorted((r["rid"], r["__row"], r["doc_id"], r["text"]) for r in got.collect())
    assert kept == [(i, -i, *rows[i]) for i in brute_kept(rows)]


def test_recall_of_similar_pairs(spark):
    """Pairs of similarity 0.8 to 0.95: nine of ten at least are found."""
    rng = random.Random(7)
    vocabulary = [f"t{i}" for i in range(4000)]
    rows, pairs = [], 0
    while pairs < 300:
        words = [rng.choice(vocabulary[: 40 * 10 ** rng.randrange(3)]) for _ in range(rng.randrange(60, 300))]
        other = list(words)
        for p in rng.sample(range(len(words)), max(1, len(words) * rng.randrange(5, 25) // 1000)):
            other[p] = rng.choice(vocabulary)
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        if similar(a, b) and 20 * len(a & b) < 19 * len(a | b):
            rows += [(2 * pairs, " ".join(words), 0, 0), (2 * pairs + 1, " ".join(other), 0, 0)]
            pairs += 1
    kept = {r.doc_id for r in near_copies.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(2 * i in kept for i in range(pairs))
    assert sum(2 * i + 1 not in kept for i in range(pairs)) >= 0.9 * pairs


def test_empty_table(spark):
    assert near_copies.drop_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
