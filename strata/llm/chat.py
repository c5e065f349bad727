"""Chat formatting by columnar byte assembly.

Template, per turn:   ``### `` role ``\\n`` text ``</turn>\\n``

Inside roles and texts a backslash goes before every ``\\``, ``#`` and ``<`` (and
before a line end in a role), so no control string of the template can stand in a text,
and dropping those backslashes gives the text back. The loss mask is the
stretches of assistant texts, as code points of the formatted conversation.

*Assembly.* A batch of turns is never joined as Python strings. Roles and texts
arrive as Arrow buffers; numpy finds the bytes to escape, the segments' lengths (header,
role, separator, text, footer), their cumulative offsets, and for each byte its
place in the output; headers and contents are scattered into one preallocated
buffer, which becomes an Arrow string column without another copy.

*Grouping.* Turns meet by conversation (hash partitioning), sorted by turn, so a
conversation's turns follow each other; one that crosses batches is carried
over. Memory holds one batch and the conversation at its end.

Defined results: a null text is empty, a null role is an empty role. Equal turn
numbers are ordered by role and text; null turns come first. Rows with a null
conversation id form one conversation. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, SEP, FOOT = b"### ", b"\n", b"</turn>\n"
SCHEMA = "conv_id long, formatted string, loss array<struct<start: long, end: long>>, n_turns long"
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b"\\#<")] = True
_ROLE_ESCAPED = _ESCAPED.copy()
_ROLE_ESCAPED[ord("\n")] = True


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column without nulls as one byte array and the offsets into it."""
    values = column.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _escape_places(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes get a backslash, how many do before each byte, and each row's escaped length."""
    marked = table[data]
    upto = np.concatenate([[0], np.cumsum(marked)])
    return marked, upto[:-1], np.diff(offsets) + upto[offsets[1:]] - upto[offsets[:-1]]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray, marked: np.ndarray, before: np.ndarray) -> None:
    """Copy rows of data to their places, each marked byte after a backslash."""
    row = np.repeat(np.arange(len(at)), np.diff(offsets))
    first = before[np.minimum(offsets[:-1], max(0, len(before) - 1))] if len(before) else np.zeros(len(at), np.int64)
    place = at[row] + np.arange(len(data)) - offsets[row] + before - first[row] + marked
    out[place] = data
    out[place[marked] - 1] = ord("\\")


def _constant(out: np.ndarray, at: np.ndarray, text: bytes) -> None:
    out[at[:, None] + np.arange(len(text))] = np.frombuffer(text, np.uint8)


def format_turns(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns formatted end to end: bytes, each turn's offset, and where its text starts and ends."""
    (r, r_off), (t, t_off) = _bytes(roles), _bytes(texts)
    r_mark, r_before, r_len = _escape_places(r, r_off, _ROLE_ESCAPED)
    t_mark, t_before, t_len = _escape_places(t, t_off, _ESCAPED)
    lengths = len(HEAD) + r_len + len(SEP) + t_len + len(FOOT)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    role_at = offsets[:-1] + len(HEAD)
    text_at = role_at + r_len + len(SEP)
    out = np.empty(offsets[-1], np.uint8)
    _constant(out, offsets[:-1], HEAD)
    _scatter(out, role_at, r, r_off, r_mark, r_before)
    _constant(out, role_at + r_len, SEP)
    _scatter(out, text_at, t, t_off, t_mark, t_before)
    _constant(out, text_at + t_len, FOOT)
    return out, offsets, text_at, text_at + t_len


def _conversations(turns: pa.Table) -> pa.RecordBatch:
    """Whole conversations (rows in order) as formatted strings and loss masks."""
    turns = turns.combine_chunks()
    ids = turns.column("conv_id")
    keys = np.array(ids.fill_null(0).to_numpy()), np.array(ids.is_null().to_numpy())
    new = np.ones(len(turns), bool)
    new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
    first = np.nonzero(new)[0]
    roles, texts = (turns.column(c).combine_chunks() for c in ("role", "text"))
    out, offsets, start, stop = format_turns(roles, texts)
    conv_off = np.append(offsets[first], offsets[-1])
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    conv = np.cumsum(new) - 1
    spoken = np.nonzero(np.array([x == b"assistant" for x in roles.to_pylist()], bool))[0] if len(turns) else np.zeros(0, np.int64)
    base = points[conv_off[conv[spoken]]]
    spans = pa.StructArray.from_arrays([pa.array(points[x[spoken]] - base) for x in (start, stop)], ["start", "end"])
    per_conv = np.concatenate([[0], np.cumsum(np.bincount(conv[spoken], minlength=len(first)))]).astype(np.int32)
    text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(conv_off.astype(np.int64)), pa.py_buffer(out))
    cols = [ids.combine_chunks().take(pa.array(first)), text.cast(pa.string()), pa.ListArray.from_arrays(pa.array(per_conv), spans), pa.array(np.diff(np.append(first, len(turns))))]
    return pa.RecordBatch.from_arrays(cols, ["conv_id", "formatted", "loss", "n_turns"])


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, loss, n_turns: one row per conversation. See the module's docstring."""
    as_bytes = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).cast("binary")
    rows = turns.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), as_bytes(role_col).alias("role"), as_bytes(text_col).alias("text"))
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            last = ids[batch.num_rows - 1]
            same = np.array(ids.is_null().to_numpy(zero_copy_only=False)) if not last.is_valid else np.array((ids.to_numpy(zero_copy_only=False) == last.as_py()))
            cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if held and (cut or held[-1].column(0)[-1] != ids[0] and held[-1].column(0)[-1].is_valid | ids[0].is_valid):
                yield _conversations(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield _conversations(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield _conversations(pa.Table.from_batches(held))

    return rows.mapInArrow(run, SCHEMA)


def unescape(text: str) -> str:
    """Drop each backslash that escapes the sign after it."""
    out, at = [], 0
    while (i := text.find("\\", at)) >= 0:
        out += [text[at:i], text[i + 1 : i + 2]]
        at = i + 2
    return "".join(out) + text[at:]


def parse(formatted: str) -> list[tuple[str, str]]:
    """The formatted conversation's (role, text) pairs."""
    out, at = [], 0
    head, sep, foot = HEAD.decode(), SEP.decode(), FOOT.decode()
    while at < len(formatted):
        if not formatted.startswith(head, at):
            raise ValueError(f"no turn begins at {at}")
        end = at + len(head)
        while formatted[end] != sep:
            end += 2 if formatted[end] == "\\" else 1
        stop = formatted.index(foot, end)  # a '<' inside a text always has a backslash before it
        while formatted[stop - 1] == "\\" and _odd_backslashes(formatted, stop):
            stop = formatted.index(foot, stop + 1)
        out.append((unescape(formatted[at + len(head) : end]), unescape(formatted[end + 1 : stop])))
        at = stop + len(foot)
    return out


def _odd_backslashes(text: str, stop: int) -> bool:
    n = 0
    while stop - n > 0 and text[stop - n - 1] == "\\":
        n += 1
    return n % 2 == 1
