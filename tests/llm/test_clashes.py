"""Extra columns named like the operators' own, and tables in which one key holds half of all rows."""

import random
from collections import Counter

import pytest
from strata.llm import decontaminate, exact_dedup, hash_tree, importance, mixing, names, near_copies, pii

NAMES = ["__row", "__ROW_", "rid", "row", "__gone_id", "__gone_th", "__id", "__source", "__text_hash", "__nth", "__times", "__alike", "__copy", "size", "taken", "id", "t", "th"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(5, 30))), "ab"[i % 2]) for i in range(40)]
    extra = ", ".join(f"`{n}` long" for n in NAMES)
    return spark.createDataFrame([(*r, *range(k, k + len(NAMES))) for k, r in enumerate(rows)], f"doc_id long, text string, source string, {extra}")


def test_fresh_names(docs):
    assert names.fresh(docs, "row") == "__row__" and names.fresh(docs, "other") == "__other"


def test_rows_come_back_whole(spark, docs):
    every = Counter(docs.collect())
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    item = spark.createDataFrame([(1, docs.first().text)], "item_id long, text string")
    made = {
        "quality": importance.keep_good(docs, labels),
        "near": near_copies.drop_near_duplicates(docs),
        "exact": exact_dedup.drop_duplicates(docs),
        "clean": decontaminate.drop_contaminated(docs, item),
        "mixed": mixing.apply_mix(docs, mixing.mix(docs)),
    }
    for name, df in made.items():
        assert df.columns == docs.columns, name
        got = Counter(df.collect())
        assert got and all(n <= every[r] * (2 if name == "mixed" else 1) for r, n in got.items()), name
    assert made["clean"].count() == 39
    assert hash_tree.assign_shards(docs, hash_tree.uniform_tree(24)).count() == 40
    assert pii.find_spans(docs).count() == 40


@pytest.mark.parametrize("hot", [(None, ""), (None, None), (7, "the same text"), (None, "the same text")])
def test_half_of_the_rows_alike(spark, hot):
    rng = random.Random(8)
    rows = [(*hot, "a")] * 300 + [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(9)), "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    groups = exact_dedup.duplicate_groups(docs).collect()
    own = [r for r in groups if r.group_size == 300]
    assert len(groups) == 600 and len(own) == 300 and sum(r.kept for r in own) == 1
    assert exact_dedup.drop_duplicates(docs).count() == 301
    assert near_copies.drop_near_duplicates(docs).count() == 301
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == 600 and all(0 <= r.taken <= 2 * r.size for r in mixed)
    per = {s: sum(r.taken for r in mixed if r.source == s) for s in "ab"}
    for s in "ab":
        assert abs(per[s] - next(r.target for r in mixed if r.source == s)) <= 2
    placed = hash_tree.assign_shards(docs, hash_tree.uniform_tree(24)).collect()
    slots = sorted((r.shard, r.slot) for r in placed)
    sizes = Counter(r.shard for r in placed)
    assert slots == [(s, n) for s in sorted(sizes) for n in range(sizes[s])]
