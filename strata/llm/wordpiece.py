"""Token counts by a linear longest-match automaton.

Greedy word-piece segmentation takes, again and again, the longest vocabulary
entry that begins where the last one ended. The automaton is the vocabulary's trie with, for each
node, a failure link (where matching goes on when no child fits) and the number of
pieces that following the link pops off. One pass over a word's symbols then counts its pieces:
each step either descends or follows a failure link, so the work is linear, and no piece is ever built.

Symbols are bytes, plus one symbol for a word's end (entries that close a word carry the
suffix ``</w>``). Every byte and every closed byte is an entry of such vocabularies,
so no word is unknown; a vocabulary that lacks some may fail inside a word, which then counts as
one unknown piece.

The trie is built once on the driver from the vocabulary file and broadcast (its size is
the vocabulary's, whatever the input). A task counts each distinct word of a batch once.

Words are runs of letters, single digits and runs of other signs, lower-cased, after NFC.

Defined results: a null or empty text has no words and no tokens. Repeated rows
come back as often as they came. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices

END = 256
SUFFIX = "</w>"
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
CACHE = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def entries(path: str) -> list[list[int]]:
    """The vocabulary's entries as symbols; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    letters, out = byte_alphabet(), []
    for token in spec["model"]["vocab"]:
        if token in special:
            continue
        body, closed = (token[: -len(SUFFIX)], [END]) if token.endswith(SUFFIX) and token != SUFFIX else (token, [])
        out.append([letters[c] for c in body] + closed)
    return out


class Automaton:
    """Trie with failure links and popped-piece counts."""

    def __init__(self, vocabulary: list[list[int]]):
        self.child: dict[int, int] = {}
        depth, parent, symbol, final = [0], [0], [0], [False]
        for entry in vocabulary:
            node = 0
            for s in entry:
                nxt = self.child.get(node << 9 | s)
                if nxt is None:
                    nxt = self.child[node << 9 | s] = len(depth)
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    symbol.append(s)
                    final.append(False)
                node = nxt
            if node:
                final[node] = True
        self.fail, self.pops = [-1] * len(depth), [0] * len(depth)
        for node in sorted(range(1, len(depth)), key=depth.__getitem__):
            if final[node]:
                self.fail[node], self.pops[node] = 0, 1
                continue
            at, popped = self.fail[parent[node]], self.pops[parent[node]]
            while at >= 0 and (at << 9 | symbol[node]) not in self.child:
                popped += self.pops[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.pops[node] = self.child[at << 9 | symbol[node]], popped

    def count(self, word: bytes) -> int:
        """Pieces of one word, closed by the end symbol; 1 if some part is in no entry."""
        child, fail, pops = self.child, self.fail, self.pops
        node = pieces = 0
        for s in (*word, END):
            nxt = child.get(node << 9 | s)
            while nxt is None:
                pieces += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                nxt = child.get(node << 9 | s)
            node = nxt
        while node:
            pieces += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return pieces


class Counter:
    """Counts for texts, each distinct word once, in a bounded cache."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.cache = automaton, {}

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        words = [WORDS.findall((t if t.isascii() else unicodedata.normalize("NFC", t)).lower()) if t else [] for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        for w in {w for own in words for w in own}.difference(self.cache):
            self.cache[w] = self.automaton.count(w.encode())
        cache = self.cache
        return [len(own) for own in words], [sum(map(cache.__getitem__, own)) for own in words]


_counters: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens: one row per input row. See the module's docstring."""
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(entries(vocabulary_path)))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        if id(automaton) not in _counters:
            _counters.clear()
            _counters[id(automaton)] = Counter(automaton)
        counter = _counters[id(automaton)]
        for batch in batches:
            for part in slices(batch, 1):
                n_words, n_tokens = counter.count(part.column(1).to_pylist())
                cols = [part.column(0), pa.array(np.array(n_words, np.int64)), pa.array(np.array(n_tokens, np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
