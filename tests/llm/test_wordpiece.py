import random

import public_tokenizers

from strata.llm import wordpiece as wp

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(vocabulary, word):
    """Greedy longest match by trying every length."""
    symbols, at, pieces = [*word, wp.END], 0, 0
    while at < len(symbols):
        stop = next((e for e in range(len(symbols), at, -1) if tuple(symbols[at:e]) in vocabulary), None)
        if stop is None:
            return 1
        at, pieces = stop, pieces + 1
    return pieces


def test_small_vocabularies_match_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        entries = [[rng.randrange(97, 100) for _ in range(rng.randrange(1, 6))] + ([wp.END] if rng.random() < 0.5 else []) for _ in range(rng.randrange(1, 15))]
        if rng.random() < 0.7:
            entries += [[x] for x in (97, 98, 99, wp.END)]
        automaton, known = wp.Automaton(entries), {tuple(e) for e in entries}
        for _ in range(30):
            word = bytes(rng.randrange(97, 100) for _ in range(rng.randrange(0, 12)))
            assert automaton.count(word) == brute(known, word), (entries, word)


def test_real_vocabulary_matches_brute_force(spark):
    entries = wp.entries(PATH)
    known = {tuple(e) for e in entries}
    texts = [(1, "The quick brown fox's 42 naïve cafés!!", 0), (2, None, 0), (3, "", 0), (4, "日本語 text\tzzzzzzqqqq", 0), (1, "x " * 50_000, 0), (None, "a", 0)]
    got = wp.count_tokens(spark.createDataFrame(texts, "doc_id long, text string, n_tokens int"), PATH).collect()
    want = []
    for i, t, _ in texts:
        words = wp.WORDS.findall((t or "").lower())
        want.append((i, len(words), sum(brute(known, w.encode()) for w in words)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert wp.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
