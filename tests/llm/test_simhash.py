import random

import numpy as np
import pytest
import xxhash

from strata.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, component_id long"


def brute_fp(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) > len(grams):
            out |= 1 << bit
    return out


def brute_components(fps, most):
    """fps: value -> smallest id; -> value -> smallest id reachable."""
    values = sorted(fps)
    a = np.array(values, np.uint64)
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.nonzero(np.bitwise_count(a ^ a[i]) <= most)[0]:
            parent[find(int(j))] = find(i)
    least = {}
    for i, v in enumerate(values):
        r = find(i)
        least[r] = min(least.get(r, 1 << 62), fps[v])
    return {v: least[find(i)] for i, v in enumerate(values)}


def near_values(n, seed):
    """Random values, chains of close ones, and a dense ball."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        out.append(rng.choice(out) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    ball = rng.getrandbits(64)
    return out + [ball ^ (1 << i) ^ (1 << j) for i in range(16) for j in range(i)]


@pytest.mark.parametrize(("most", "crowd"), [(2, 64), (2, 4), (4, 20)])
def test_links_match_brute_force(spark, most, crowd):
    values = sorted(set(near_values(300, most)))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), most, crowd)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    assert roots == {r.node: r.root for r in simhash.components(links, small=0).collect()}
    want = brute_components({v: i for i, v in enumerate(values)}, most)
    got = {}
    for i, s in enumerate(signed):
        got.setdefault(roots.get(s, s), []).append(i)
    expected = {}
    for i, v in enumerate(values):
        expected.setdefault(want[v], []).append(i)
    assert sorted(map(tuple, got.values())) == sorted(map(tuple, expected.values()))


def test_groups_match_brute_force(spark):
    texts = {1: "a b c d e f g h", 2: "A b c d e f g h", 3: None, 4: "", 5: " \t", 6: "one", 7: "one two", 8: "x " * 5000, 9: "a b c d e f g h i"}
    rows = [(i, t, -1) for i, t in texts.items()] + [(1, texts[1], -1), (None, "only null id", -1)]
    got = simhash.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    fps = {}
    for i, t in texts.items():
        fps[brute_fp(t)] = min(i, fps.get(brute_fp(t), i))
    want = brute_components(fps, 2)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert int(r.fingerprint, 16) == brute_fp(texts[r.doc_id]) and len(r.fingerprint) == 16
            assert r.component_id == want[brute_fp(texts[r.doc_id])]


def test_empty_table(spark):
    assert simhash.near_duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_drop_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    near = base[:100] + ["changed"] + base[101:]
    other = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(5, " ".join(base), 0), (2, " ".join(near), 0), (9, " ".join(base), 1), (7, " ".join(other), 0), (7, " ".join(other), 0), (None, "short", 0), (8, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid long")
    got = near_copies.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(got.collect(), key=str) == sorted([docs.collect()[i] for i in (1, 3, 5, 6)], key=str)
