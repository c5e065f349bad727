"""What the mix delivers in whole documents, against its targets."""

import random
from collections import Counter, defaultdict

import pytest

from strata.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def delivered(rows, spark):
    """Per source: words, target, words taken, words delivered, longest document; and the copies of each row."""
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs).persist()
    per = defaultdict(lambda: [0, 0, 0, 0, 0])
    for r in mixed.collect():
        own = per[r.source]
        own[0], own[1] = r.source_size, r.target
        own[2] += r.taken
        own[4] = max(own[4], r.size)
    out = mixing.apply_mix(docs, mixed).collect()
    for r in out:
        per[r.source][3] += len(r.text.split())
    return per, Counter(out)


def table(sizes, ids=True):
    rng = random.Random(8)
    names = [s for s, many in sizes.items() for _ in range(many)]
    return [(i if ids else None, f"x{i} " + "w " * (rng.randrange(5, 60) if ids else 9), s) for i, s in enumerate(names)]


@pytest.mark.parametrize(
    ("sizes", "low", "high"),
    [({"a": 290, "b": 175, "c": 260, "d": 200, "e": 75}, 0.3, 0.5), ({"a": 300, "b": 250, "c": 400, None: 50}, 0.5, 0.95)],
)
@pytest.mark.parametrize("ids", [True, False])
def test_delivered_words_meet_targets(spark, sizes, low, high, ids):
    """Sources of ratio below 0.5, between 0.5 and 1 and between 1 and 2, with ids and without."""
    per, copies = delivered(table(sizes, ids), spark)
    assert low < min(target / size for size, target, *_ in per.values()) < high
    for _, target, taken, words, longest in per.values():
        assert abs(words - taken) <= longest and abs(words - target) <= longest + 1
    assert max(copies.values()) <= 2
