"""Exact dedup, mixing, sharding and decontamination against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from strata.llm import decontaminate, exact_dedup, hash_tree, mixing

SCHEMA = "doc_id long, text string, source string, n long, best long, kept string, salt long"


def docs_of(rows, spark):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    signs = ["a", "b c", " ", "\t", "\n", "é", "日", "word "]
    out = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(0, 5))), rng.choice(["s1", "s2", "é", None])) for i in range(120)]
    hot = [(1000 + i, "hot text", "s1") for i in range(200)]
    return out + hot + [(None, "a", None), (None, "a", "s9"), (-5, "hot  text", "s1"), (7, "a", "s2"), (7, "a", "s2"), (3000, None, "s2"), (3001, "x " * 20_000, "s2")]


def test_exact_dedup(spark, rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((i, len(t or "")))
    want = []
    for norm, own in groups.items():
        best = min(own, key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        done = False
        for i, n in sorted(own, key=lambda x: x != best):
            kept = (i, n) == best and not done
            done |= kept
            want.append((i, best[0], len(own), kept, hashlib.sha256(norm.encode()).hexdigest()))
    for salts in (1, 8):
        got = exact_dedup.duplicate_groups(docs_of(rows, spark), salts=salts).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = exact_dedup.drop_duplicates(docs_of(rows, spark))
    assert kept.columns == docs_of(rows, spark).columns and kept.count() == len(groups)
    assert exact_dedup.duplicate_groups(docs_of([], spark)).count() == 0


def water_filling(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(spark, rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = water_filling(sizes)
    got = mixing.mix(docs_of(rows, spark)).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs_of(rows, spark).repartition(7)).collect()))
    assert mixing.mix(docs_of([], spark)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(docs_of([(1, None, "a"), (2, " ", None)], spark)).collect())
    mixed = mixing.apply_mix(docs_of(rows, spark), mixing.mix(docs_of(rows, spark)))
    assert mixed.columns == docs_of(rows, spark).columns and mixed.count() > 0


def test_blocks_of_many_words(spark):
    """Blocks of 16 words, shards of 8 blocks: quotas hold and sources come near their targets."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 90), f"s{i % 5}") for i in range(600)]
    df = docs_of(rows, spark)
    plain = mixing.mix(df).collect()
    target = {r.source: r.target for r in plain}
    import strata.llm.mixing as m

    shift = m.F.shiftright
    try:
        m.F.shiftright = lambda c, n: m.F.lit(16)  # a block size that only large tables have
        got = m.mix(df, shard_blocks=8).collect()
    finally:
        m.F.shiftright = shift
    taken, quota = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.block == 16
        taken[r.source] += r.taken
        quota[r.source, r.mix_shard] = r.shard_quota
    assert len(quota) > 50
    for s, t in target.items():
        assert abs(taken[s] - t) < 0.05 * t


def test_highest_quotients_match_a_heap(spark):
    rng = random.Random(6)
    data, want = [], {}
    for g in range(12):
        weights = [rng.choice([0, 1, 5, 5, 7.5, 100, rng.random()]) for _ in range(rng.randrange(1, 9))]
        seats = rng.randrange(0, 60) if any(weights) else 0
        heap = [(-w, i, 0) for i, w in enumerate(weights) if w > 0]
        heapq.heapify(heap)
        got = [0] * len(weights)
        for _ in range(seats):
            _, i, k = heapq.heappop(heap)
            got[i] += 1
            heapq.heappush(heap, (-weights[i] / (2 * k + 3), i, k + 1))
        for i, w in enumerate(weights):
            data.append((g, i, float(w), seats))
            want[g, i] = got[i]
    df = spark.createDataFrame(data, "g int, i int, w double, seats long")
    assert {(r.g, r.i): r.quota for r in mixing.highest_quotients(df, ["g"], ["i"], "w", "seats").collect()} == want


def test_sharding(spark, rows):
    tree, grown = hash_tree.uniform_tree(24), hash_tree.uniform_tree(25)
    got = hash_tree.assign_shards(docs_of(rows, spark), tree, grown).collect()
    text = defaultdict(list)
    for i, t, _ in rows:
        text[i].append((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())))
    assert len(got) == len(rows)
    slots, by_id = defaultdict(list), {}
    for r in got:
        assert (r.size, r.text_crc32) in text[r.doc_id] and r.law == "key"
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        if r.doc_id is not None:
            assert by_id.setdefault(r.doc_id, r.shard) == r.shard
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    other = hash_tree.assign_shards(docs_of([(i, "other", None) for i in by_id], spark), tree, grown).collect()
    assert {r.doc_id: r.shard for r in other} == by_id
    assert hash_tree.assign_shards(docs_of([], spark), tree).count() == 0


def test_weights_steer_and_confine(spark):
    ids = spark.range(20_000)
    tree = {0: {0: {0: 1.0, 1: 3.0}, 1: {2: 2.0}}, 1: {2: {3: 2.0, 4: 0.0}}}
    heavier = {0: {0: {0: 1.0, 1: 3.0}, 1: {2: 4.0}}, 1: {2: {3: 2.0, 4: 0.0}}}
    both = ids.select(hash_tree.shard_of(ids["id"], tree).alias("a"), hash_tree.shard_of(ids["id"], heavier).alias("b")).collect()
    count = defaultdict(int)
    for r in both:
        count[r.a] += 1
        if r.a != r.b:
            assert r.b in (0, 1, 2)  # only into the region whose weight rose
            assert r.a == 3 or r.b == 2  # and inside it only into the rack whose weight rose
    for shard, share in {0: 1 / 8, 1: 3 / 8, 2: 2 / 8, 3: 2 / 8}.items():
        assert abs(count[shard] / 20_000 - share) < 0.02
    assert 4 not in count


def words_of(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def brute_contained(docs, items, share=0.8, width=5):
    sets = lambda ws: {" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()
    least = {}
    for i, t in items:
        least[tuple(words_of(t))] = min(i, least.get(tuple(words_of(t)), i))
    out = set()
    for d, t in docs:
        own = sets(words_of(t))
        for ws, i in least.items():
            need = sets(list(ws))
            if need and len(need & own) >= share * len(need) - 1e-9:
                out.add((d, i, len(need), len(need & own)))
    return out


def test_decontamination(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(1, 40))) for i in range(30)] + [(90, None), (91, ""), (92, "...")]
    items += [(50, items[3][1].upper() + "!!"), (51, items[4][1])]
    docs = []
    for d in range(80):
        body = text(rng.randrange(0, 60)).split()
        own = items[rng.randrange(30)][1].split()
        if rng.random() < 0.7:
            if rng.random() < 0.5 and own:
                own[rng.randrange(len(own))] = "changed"
            body[len(body) // 2 : len(body) // 2] = own
        docs.append((d, " ".join(body)))
    docs += [(None, "x " + items[9][1]), (5, items[20][1]), (5, items[20][1]), (200, None), (201, ""), (202, items[7][1]), (203, text(30_000))]
    ddf = docs_of([(*d, None) for d in docs], spark)
    idf = spark.createDataFrame(items, "item_id long, text string")
    for most in (2_000_000, 0):
        got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in decontaminate.contamination(ddf, idf, most_rows=most).collect()}
        want = brute_contained(docs, items)
        assert {x[:3] for x in got} == {x[:3] for x in want}
        assert got <= want
    clean = decontaminate.drop_contaminated(ddf, idf)
    assert clean.columns == ddf.columns
    bad = {w[0] for w in brute_contained([(k, t) for k, (_, t) in enumerate(docs)], items)}
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(str(d) for k, (d, _) in enumerate(docs) if k not in bad)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs_of([], spark), idf).count() == 0
    assert decontaminate.drop_contaminated(ddf, none).count() == len(docs)
