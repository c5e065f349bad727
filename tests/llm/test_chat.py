import random

import pyarrow as pa

from strata.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, loss string"


def brute(turns):
    """(formatted, loss spans) by plain string building."""
    esc = lambda s, more: "".join("\\" + c if c in "\\#<" + more else c for c in s)
    out, spans = "", []
    for role, text in turns:
        out += "### " + esc(role or "", "\n") + "\n"
        start = len(out)
        out += esc(text or "", "")
        if role == "assistant":
            spans.append((start, len(out)))
        out += "</turn>\n"
    return out, spans


def test_round_trip_of_any_text(spark):
    rng = random.Random(1)
    alphabet = ["\\", "#", "<", "/turn>", "### ", "assistant", "\n", "é", "日", "𝄞", " ", "a", "</turn>\n"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 6)):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "we\nird#", None]), rng.choice([text, text, None]), "x"))
    rows.append((99, 0, "user", "long " * 200_000, "x"))
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append((r[2], r[3]))
    rng.shuffle(rows)
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(by_conv)
    for r in got:
        formatted, spans = brute(by_conv[r.conv_id])
        assert r.formatted == formatted and [tuple(x) for x in r.loss] == spans and r.n_turns == len(by_conv[r.conv_id])
        assert chat.parse(r.formatted) == [(a or "", b or "") for a, b in by_conv[r.conv_id]]


def test_conversation_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(c, t, "assistant", f"{c}-{t}", None) for c in (None, 1, 2, 3) for t in range(20)]
        got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
        assert sorted(got, key=str) == [1, 2, 3, None]
        for c, r in got.items():
            assert chat.parse(r.formatted) == [("assistant", f"{c}-{t}") for t in range(20)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", "b", None), (1, 0, "user", "a", None), (1, 0, "user", "a", None), (1, None, "system", "", None)]
    (r,) = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert chat.parse(r.formatted) == [("system", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_turns_at_all():
    out, offsets, _, _ = chat.format_turns(pa.array([], pa.binary()), pa.array([], pa.binary()))
    assert len(out) == 0 and offsets.tolist() == [0]
