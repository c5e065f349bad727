"""Token ids in length-delimited binary records, with a separate offset index.

*Record file.* One frame per document, in ascending id order over all files:

    8 bytes   length of the payload, unsigned little-endian
    4 bytes   masked CRC-32 of those 8 bytes
    payload
    4 bytes   masked CRC-32 of the payload

    payload:  8 bytes signed id, 1 byte flags (1: the id is null, 2: ids are 4 bytes wide,
              else 2), then the ids, little-endian

The mask is ((crc >> 15 | crc << 17) + 0xa282ead8) mod 2**32, so that a CRC
stored inside data that is checked by a CRC does no harm. Ids are 2 bytes wide where the
vocabulary allows it.

*Index file* (``.idx``), beside each record file: for each frame 8 bytes offset and 8 bytes
count of ids, so that one record can be read without scanning (``read_record``).

*Writing.* Documents are ordered by range partitioning on the id; each task
encodes its range and writes one record file and one index under a name that
no other attempt uses. The task's row (file, rows, ids) is committed by Spark's
own Parquet commit in the manifest; files that the manifest does not name are leftovers of lost
attempts and are never read. Files go through pyarrow's file
systems by URI, so the shared folder may be any store that these reach. What
the driver sees is one small row per file.

*Encoding.* The whole text, by the tokenizers library. Byte-level pre-tokenisation always ends a token between a sign
that is no white space and white space, between a letter and a dot or comma, and on both sides of a line end that stands
alone; texts are cut there (``cut_places``, for signs that every version of Unicode reads alike; elsewhere a
piece is longer). A run of texts is cut in numpy, its pieces are made distinct by Arrow, only pieces not
met before are encoded, and ids are gathered by offsets from one flat array. That array and
its dictionary are bounded (``CACHE``) and start anew beyond.

Defined results: a null text is the empty text, whose record holds only the end
id. Null ids come first. Rows that repeat an id follow each other, ordered by text. An
empty table writes no frames. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import slices
from ..scratch import materialize, scratch_path

#: Pieces of signs that every version of Unicode reads alike, with no white space but one blank before them.
PLAIN = re.compile("[ ]?[!-~\u00c0-\u00ff]+")
END_ID = 0
#: Most pieces, and most ids in units of 16, that a task keeps.
CACHE = 1_000_000
#: Bytes of texts encoded at once, and of record files read at once.
RUN = 8_000_000


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked_crc(head).to_bytes(4, "little"), payload, masked_crc(payload).to_bytes(4, "little")))


def pack(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    flags = (doc_id is None) | wide << 1
    return (doc_id or 0).to_bytes(8, "little", signed=True) + bytes([flags]) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags = payload[8]
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")
    return (None if flags & 1 else int.from_bytes(payload[:8], "little", signed=True)), ids


def payload_at(data: bytes, at: int) -> tuple[bytes, int]:
    """The checked payload of the frame at this place, and the place after it."""
    head = data[at : at + 8]
    size = int.from_bytes(head, "little")
    if masked_crc(head) != int.from_bytes(data[at + 8 : at + 12], "little"):
        raise ValueError(f"damaged length at {at}")
    payload = bytes(data[at + 12 : at + 12 + size])
    if len(payload) != size or masked_crc(payload) != int.from_bytes(data[at + 12 + size : at + 16 + size], "little"):
        raise ValueError(f"damaged record at {at}")
    return payload, at + 16 + size


def cut_places(data: np.ndarray) -> np.ndarray:
    """True at each byte of UTF-8 text before which it may be cut without changing its tokens."""
    latin = np.zeros(len(data), bool)  # second bytes of U+00C0 to U+00FF
    latin[1:] = data[:-1] == 0xC3
    plain = (data > 0x20) & (data < 0x7F)
    solid = plain | latin
    small = data | 0x20
    letter = (small >= 0x61) & (small <= 0x7A) & plain | latin & (data != 0x97) & (data != 0xB7)
    line = data == 0x0A
    cut = np.zeros(len(data), bool)
    cut[1:] = solid[:-1] & (line | (data == 0x20))[1:] | letter[:-1] & ((data == 0x2E) | (data == 0x2C))[1:]
    cut[2:] |= solid[:-2] & line[1:-1] & (plain | (data == 0xC3))[2:]
    return cut


class Encoder:
    """Texts to ids as bytes; the tokenizer's file is read once on the driver and travels as text."""

    def __init__(self, spec: str, wide: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads of a pool would spin
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_str(spec), "<u4" if wide else "<u2"
        (self.line,) = self._ids(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, self.kind)
        self.ends = np.zeros(1 << 12, np.int64)  # of piece n in flat, at n + 1

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces; they get the next numbers."""
        plain = [x for x in pieces if PLAIN.fullmatch(x)]
        odd = [x for x in pieces if not PLAIN.fullmatch(x)]
        # A line end between two plain pieces is a token of its own, and no plain piece holds one: many are encoded as one text.
        lines = ["\n".join([*plain[at : at + 1000], ""]) for at in range(0, len(plain), 1000)]
        for some, ids in ((plain, self._ids(lines)), (odd, self._ids(odd))):
            flat = np.fromiter(chain.from_iterable(ids), self.kind)
            if some is plain:
                gaps = flat == self.line
                sizes, flat = np.diff(np.flatnonzero(gaps), prepend=-1) - 1, flat[~gaps]
            else:
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            if len(sizes) != len(some):
                raise ValueError("the tokenizer does not keep line ends apart")
            self._store(some, flat, sizes)

    def _store(self, pieces: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self.known), len(self.known) + len(pieces)
        if last >= len(self.ends):
            self.ends = np.append(self.ends, np.zeros(last, np.int64))
        self.ends[first + 1 : last + 1] = self.ends[first] + np.cumsum(sizes)
        if self.ends[last] > len(self.flat):
            self.flat = np.append(self.flat, np.zeros(int(self.ends[last]), self.kind))
        self.flat[self.ends[first] : self.ends[last]] = flat
        self.known.update(zip(pieces, range(first, last), strict=True))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        if len(self.known) > CACHE or self.ends[len(self.known)] > 16 * CACHE:
            self._forget()
        texts = texts.cast(pa.large_string()).fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        if bounds[0] == bounds[-1] or buffer is None:
            return [b""] * len(texts)
        data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        cut = cut_places(data)
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        places = np.flatnonzero(cut)
        whole = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(np.append(places, len(data))), pa.py_buffer(np.ascontiguousarray(data)))
        coded = whole.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn([x for x in distinct if x not in self.known])
        pieces = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        start = self.ends[pieces]
        sizes = self.ends[pieces + 1] - start
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(start - upto[:-1], sizes) + np.arange(upto[-1])].tobytes()
        ends = (upto[np.searchsorted(places, bounds)] * np.dtype(self.kind).itemsize).tolist()
        return [ids[a:b] for a, b in pairwise(ends)]


_encoders: dict[int, Encoder] = {}


def _encoder(spec: str, wide: bool) -> Encoder:
    key = hash((spec, wide))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec, wide)
    return _encoders[key]


def write_records(docs: DataFrame, path: str, spec: str, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs into record files below path; the manifest: file, index, part, first, rows, ids, before."""
    spark, wide = docs.sparkSession, vocabulary > 1 << 16
    shared, end = spark.sparkContext.broadcast(spec), np.array([END_ID], "<u4" if wide else "<u2").tobytes()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The text's start splits many rows of one id and agrees with the order below.
    rows = rows.repartitionByRange(parts, F.col("id").asc_nulls_first(), F.substring("t", 1, 64)).sortWithinPartitions(F.col("id").asc_nulls_first(), "t")
    unit = 4 if wide else 2

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, wide)
        fs, root = pafs.FileSystem.from_uri(path)
        name = f"part-{uuid.uuid4().hex}.rec"
        fs.create_dir(root, recursive=True)
        at = rows_done = ids_done = 0
        first = None
        with fs.open_output_stream(f"{root}/{name}") as out, fs.open_output_stream(f"{root}/{name}.idx") as index:
            for batch in batches:
                for part in slices(batch, 1, RUN):
                    for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                        if not rows_done:
                            first = doc_id
                        whole = frame(pack(doc_id, ids + end, wide))
                        count = len(ids) // unit + 1
                        out.write(whole)
                        index.write(np.array([at, count], "<i8").tobytes())
                        at, rows_done, ids_done = at + len(whole), rows_done + 1, ids_done + count
        if not rows_done:
            fs.delete_file(f"{root}/{name}")
            fs.delete_file(f"{root}/{name}.idx")
        else:
            cols = [pa.array([x], t) for x, t in ((f"{path}/{name}", pa.string()), (first, pa.int64()), (rows_done, pa.int64()), (ids_done, pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["file", "first", "rows", "ids"])

    done = rows.mapInArrow(write, "file string, first long, rows long, ids long")
    manifest = materialize(done.withColumn("part", F.spark_partition_id()), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_records(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's files, checked: doc_id, start, n_tokens, ids (binary, 4-byte little-endian)."""
    wanted = manifest.select("file", "before", "part").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before, _ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fs, at_path = pafs.FileSystem.from_uri(file)
                start, rows, held = before, [], 0
                with fs.open_input_file(at_path) as data, fs.open_input_file(f"{at_path}.idx") as index:
                    offsets = np.frombuffer(index.read(), "<i8").reshape(-1, 2)
                    places = np.append(offsets[:, 0], data.size())
                    at = 0
                    while at < len(offsets):
                        stop = max(at + 1, int(np.searchsorted(places, places[at] + RUN, "right")) - 1)
                        block = data.read_at(int(places[stop] - places[at]), int(places[at]))
                        for offset, count in offsets[at:stop].tolist():
                            doc_id, ids = unpack(payload_at(block, offset - int(places[at]))[0])
                            if len(ids) != count:
                                raise ValueError(f"index and record differ in {file} at {offset}")
                            rows.append((doc_id, start, count, ids.tobytes()))
                            start, held = start + count, held + 4 * count
                            if held > 4_000_000:
                                yield _read_batch(rows)
                                rows, held = [], 0
                        at = stop
                if rows:
                    yield _read_batch(rows)

    return wanted.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    cols = [pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids"])


def read_record(file: str, nth: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index: for shuffled reads."""
    fs, path = pafs.FileSystem.from_uri(file)
    with fs.open_input_file(f"{path}.idx") as index:
        offset = int(np.frombuffer(index.read_at(8, 16 * nth), "<i8")[0])
    with fs.open_input_file(path) as data:
        size = int.from_bytes(data.read_at(8, offset), "little")
        return unpack(payload_at(data.read_at(size + 16, offset), 0)[0])


def export_tokens(docs: DataFrame, tokenizer_path: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs with the tokenizer in that file and read them back: doc_id, start, n_tokens, ids."""
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    vocabulary = Tokenizer.from_str(spec).get_vocab_size()
    return read_records(write_records(docs, path or scratch_path(docs.sparkSession, "records"), spec, vocabulary, id_col, text_col))
