import random

import numpy as np

from strata.llm import importance as imp

DOCS = "doc_id long, text string, kept string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed):
    """Good prose, and junk with signs after each word."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("in", "the", "on", "er", "th") for b in ("ing", "ed", "", "ly", "tion")]
    out = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        out.append((i, " ".join(w + ("$$$" if i % 5 == 0 else "") for w in own), "x"))
    return out


def test_held_out_accuracy_and_empty_texts(spark):
    rows = corpus(400, 1) + [(1000, "", "x"), (1001, None, None), (None, "the ing", "x"), (7, corpus(400, 1)[7][1], "x")]
    labels = [(i, 0 if i % 5 == 0 else 1, 0) for i in range(200)] + [(None, 1, 0), (3, None, None), (3, 1, 1)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = imp.resample(docs, marks).collect()
    assert len(got) == len(rows)
    held = {r.id: r.kept for r in got if r.id is not None and 200 <= r.id < 400}
    assert sum(v == (i % 5 != 0) for i, v in held.items()) >= 195
    assert all(r.kept and r.log_weight == 0 for r in got if r.id in (1000, 1001))
    assert len({r.kept for r in got if r.id == 7}) == 1
    again = imp.resample(docs, marks).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    kept = imp.keep_good(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_models_match_brute_force(spark):
    rows = corpus(30, 2)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id AS id", "text AS t")
    marks = spark.createDataFrame([(i, i % 2) for i in range(30)], "id long, good int")
    ratio = imp.fit(docs, marks, 512)
    raw, target = np.full(512, 0.5), np.full(512, 0.5)
    for i, text, _ in rows:
        for g in imp.ngram_buckets([text], 512)[0]:
            raw[g] += 1
            target[g] += i % 2
    assert np.allclose(ratio, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    scored = imp.score(docs, ratio).collect()
    for r in scored:
        assert abs(r.log_weight - ratio[imp.ngram_buckets([rows[r.id][1]], 512)[0]].sum()) < 1e-9


def test_kth_largest_matches_sort(spark):
    rng = random.Random(4)
    values = [rng.randrange(-(2**63), 2**63) for _ in range(300)] + [5, 5, 5, -1, 0]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 17, 150, 304, 305):
        assert imp.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_gumbel_draw_follows_the_weights():
    """Gumbel top-1 takes an item in proportion to exp(log weight)."""
    rng = np.random.default_rng(0)
    weights = np.log([1.0, 2.0, 5.0])
    first = (weights - np.log(-np.log(rng.random((20000, 3))))).argmax(1)
    assert np.allclose(np.bincount(first) / 20000, [1 / 8, 2 / 8, 5 / 8], atol=0.02)


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], DOCS)
    marks = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert imp.resample(none, marks).count() == 0
    docs = spark.createDataFrame(corpus(5, 3), DOCS)
    assert all(r.kept for r in imp.resample(docs, spark.createDataFrame([], LABELS)).collect())
