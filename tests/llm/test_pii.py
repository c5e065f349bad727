import hashlib
import math
import random
import re
from collections import Counter

from strata.llm import pii, queries

SCHEMA = "doc_id long, text string, spans string"
PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_base(text):
    out = []
    for rank, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = True
            if rank == 1:
                ok = all(int(p) <= 255 for p in m.group().split("."))
            elif rank == 2:
                total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
                ok = 14 <= len(digits) <= 19 and total % 10 == 0
            elif rank == 3:
                ok = 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), rank, m.end(), m.group()))
    return sorted(out)


def brute_terms(texts, window=60, letters=4, disclosure=0.9):
    """text -> {(start, end)} by the definition; every row counts."""
    n_e, n_t, n_te, places = Counter(), Counter(), Counter(), {}
    for t, rows_of in Counter(texts).items():
        base = brute_base(t)
        for w in set(re.findall(r"[^\W\d_]+", t.lower())):
            n_t[w] += rows_of
        for e in {(b[1], b[3].lower()) for b in base}:
            n_e[e] += rows_of
        pairs = set()
        for b in base:
            low, high = max(0, b[0] - window), b[2] + window
            for m in re.finditer(r"[^\W\d_]+", t):
                beside = low <= m.start() and m.end() <= b[0] or b[2] <= m.start() and m.end() <= high
                if beside and m.end() - m.start() >= letters and all(x[2] <= m.start() or x[0] >= m.end() for x in base):
                    places.setdefault(((b[1], b[3].lower()), m.group().lower()), set()).add((t, m.start(), m.end()))
                    pairs.add(((b[1], b[3].lower()), m.group().lower()))
        for p in pairs:
            n_te[p] += rows_of
    out, n = {t: set() for t in texts}, len(texts)
    for (e, w), k in n_te.items():
        own = math.log(n / n_e[e])
        if own > 0 and math.log(n * k / (n_t[w] * n_e[e])) >= disclosure * own:
            for t, s, x in places[e, w]:
                out[t].add((s, x))
    return out


def rows():
    rng = random.Random(2)
    signs = ["a@b.c", "x_y@é.fr", "1.2.3.4", "256.1.1.1", "00255.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (386) 555-3733", "+12", "@", "+", ".", "-", " ", "日", "𝄞", "a@b.c_d@e.f", "9", "\n"]
    out = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(0, 14))), "x") for i in range(150)]
    out += [(200 + i, f"note {i} from Quentin Zarathus mail quentin@zar.org and others with w{i} today", None) for i in range(4)]
    out += [(300 + i, f"others with today and note mail from plain{'abcdefghij'[i]} people", None) for i in range(10)]
    return out + [(None, "write to null@id.com", None), (400, None, None), (401, "", None), (402, "z" * 2000 + " 1" * 500 + " q@r.st", None), (402, "a@b.c " * 200, None), (402, "a@b.c " * 200, None)]


def test_spans_match_brute_force(spark):
    data = rows()
    found = pii.find_spans(spark.createDataFrame(data, SCHEMA)).collect()
    texts = [t or "" for _, t, _ in data]
    terms = brute_terms(texts)
    want = sorted(str((i, brute_base(t), sorted(terms[t]))) for (i, _, _), t in zip(data, texts, strict=True))
    got = sorted(str((r.id, [(b.start, b.rank, b.end, b.value) for b in r.base], sorted((x.start, x.end) for x in r.terms))) for r in found)
    assert got == want
    assert any(terms.values()) and terms["write to null@id.com"]


def test_query_columns(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in queries.op8_pii(spark, str(tmp_path)).collect()}
    want = set()
    for i, t, _ in data:
        base = brute_base(t or "")
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest()
        want.add((i, digest, *[sum(b[1] == k for b in base) for k in range(4)]))
    assert got == want


def test_sanitized_text(spark):
    data = [r for r in rows() if r[0] and 200 <= r[0] < 400]
    out = {r.doc_id: r.text for r in pii.sanitize(spark.createDataFrame(data, SCHEMA)).collect()}
    assert out[200] == "note 0 from   mail [EMAIL] and others with w0 today"
    assert out[303] == data[7][1]


def test_empty_table(spark):
    assert pii.find_spans(spark.createDataFrame([], SCHEMA)).count() == 0
    assert pii.sanitize(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text_is_linear(spark):
    data = [(1, "z" * 300_000 + " 1" * 50_000 + " 12." * 20_000 + " q@r.st", None)]
    (r,) = pii.find_spans(spark.createDataFrame(data, SCHEMA)).collect()
    assert [(b.rank, b.value) for b in r.base] == [(0, "q@r.st")]


def brute_anywhere(texts, letters=4, disclosure=0.9):
    """text -> {(start, end, full)}: rows that hold word and value count, and every place of a revealing word."""
    n, n_e, n_t, n_te = len(texts), Counter(), Counter(), Counter()
    found = {t: [m for m in re.finditer(r"[^\W\d_]+", t) if m.end() - m.start() >= letters] for t in texts}
    for t in texts:
        words, held = {m.group().lower() for m in found[t]}, {(b[1], b[3].lower()) for b in brute_base(t)}
        n_t.update(words)
        n_e.update(held)
        n_te.update((e, w) for e in held for w in words)
    full = {}
    for (e, w), k in n_te.items():
        own = math.log(n / n_e[e])
        if own > 0 and math.log(n * k / (n_t[w] * n_e[e])) >= disclosure * own:
            full[w] = full.get(w, False) or k == n_t[w]
    out = {}
    for t, ms in found.items():
        base = brute_base(t)
        apart = [m for m in ms if all(b[2] <= m.start() or b[0] >= m.end() for b in base)]
        out[t] = {(m.start(), m.end(), full[m.group().lower()]) for m in apart if m.group().lower() in full}
    return out


def spread_rows():
    """Words far from values, in rows without a value, in copies, beside several values, behind long runs without a word."""
    rng = random.Random(5)
    gap = " of the day and so on" * 12
    out = [(i, f"Zarathus{gap} wrote{i % 3} to q@zar.org.{gap} Quentinus", None) for i in range(3)]
    out += [(10, "here stands Quentinus alone, and zarathus, ZARATHUS", None), (11, None, None), (12, "", None), (None, "q@zar.org 7 " + "- " * 3000 + "behindall" + " 1" * 3000, None)]
    words = ["alpha", "Beta", "gamma", "delta", "omega", "Étude", "日日日日", "sigma", "kappa", "lambda", "abc", "x́y", "𝄞note", "theta"]
    values = ["a@b.org", "c@d.org", "1.2.3.4", "+1 (386) 555-3733", "alpha@kappa.org", "\n", "9,", "_"]
    for i in range(60):
        parts = [rng.choice(words[: 3 + i // 4]) for _ in range(rng.randrange(0, 90))] + rng.sample(values, rng.choice([0, 0, 1, 3]))
        rng.shuffle(parts)
        out.append((20 + i, " ".join(parts), None))
    return out + [(100 + i, f"copies of alpha and secretname with mail{gap} copy@cat.org", None) for i in range(12)] + [(200 + i, f"plain row {gap}", None) for i in range(60)]


def test_terms_of_whole_texts_match_brute_force(spark):
    data = spread_rows()
    texts = [t or "" for _, t, _ in data]
    found = pii.find_spans(spark.createDataFrame(data, SCHEMA).repartition(5), window=None).collect()
    terms = brute_anywhere(texts)
    want = sorted(str((i, brute_base(t), sorted(terms[t]))) for (i, _, _), t in zip(data, texts, strict=True))
    got = sorted(str((r.id, [(b.start, b.rank, b.end, b.value) for b in r.base], [tuple(x) for x in r.terms])) for r in found)
    assert got == want
    flags = [full for t in terms.values() for _, _, full in t]
    assert True in flags and False in flags


def test_query_marks_words_far_from_a_value_and_in_other_rows(spark, tmp_path):
    data = spread_rows()
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spans = {r.doc_id: r.spans.split(",") for r in queries.op8_pii(spark, str(tmp_path)).collect()}
    assert len(spans) == len(data)
    for i, t in [(0, data[0][1]), (10, data[3][1])]:
        at = t.index("Quentinus")
        assert f"term:{at}:{at + 9}" in spans[i]


def test_sanitized_words_far_from_a_value(spark):
    data = spread_rows()
    out = {r.doc_id: r.text for r in pii.sanitize(spark.createDataFrame(data, SCHEMA)).collect()}
    gap = " of the day and so on" * 12
    assert out[0] == f"[TERM]{gap} 0 to [EMAIL].{gap} [TERM]"
    assert out[10] == "here stands [TERM] alone, and [TERM], [TERM]"
    assert out[200] == data[-60][1]


def test_whole_text_of_many_words(spark):
    text = "z" * 300_000 + " 1" * 50_000 + " word" * 60_000 + " q@r.st" + " 1" * 150_000
    (r, _) = pii.find_spans(spark.createDataFrame([(1, text, None), (2, "word", None)], SCHEMA), window=None).orderBy("id").collect()
    assert [(x.start, x.end, x.full) for x in r.terms] == [(0, 300_000, True)]
