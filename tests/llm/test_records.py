import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strata.llm import records

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    signs = "ab'.,\n \t é1²_-日़\x00"
    out = [(i * 3 % 101 - 20, "".join(rng.choice(signs) for _ in range(rng.randrange(0, 40))), "x") for i in range(100)]
    return out + [(None, "null id", None), (500, None, None), (501, "", None), (7, "again", None), (7, "again", None), (502, "long text, " * 30_000, None), (503, "a <|endoftext|> b", None)]


def test_round_trip_matches_the_tokenizer(spark, rows, tmp_path):
    tokenizer = Tokenizer.from_file(PATH)
    want, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = records.export_tokens(docs, PATH, f"file://{tmp_path}/records").collect()
    order = lambda r: (r[1],)
    assert [(r[0], r[1], r[2], bytes(r[3])) for r in sorted(got, key=order)] == want


def test_shuffled_reads_and_damage(spark, rows, tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    manifest = records.write_records(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/r", spec, 50257)
    first = manifest.orderBy("part").first()
    every = records.read_records(manifest).orderBy("start").collect()
    for nth in (first.rows - 1, 0, first.rows // 2):
        doc_id, ids = records.read_record(first.file, nth)
        assert doc_id == every[nth].doc_id and ids.tobytes() == bytes(every[nth].ids)
    path = first.file.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[30] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="damaged"):
        records.read_record(first.file, 0)


def test_wide_ids_and_empty_table(spark, tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    docs = spark.createDataFrame([(1, "some text", None)], SCHEMA)
    wide = records.read_records(records.write_records(docs, f"file://{tmp_path}/w", spec, 1 << 20))
    narrow = records.read_records(records.write_records(docs, f"file://{tmp_path}/n", spec, 50257))
    assert wide.select(F.crc32("ids")).first() == narrow.select(F.crc32("ids")).first()
    assert records.export_tokens(spark.createDataFrame([], SCHEMA), PATH, f"file://{tmp_path}/e").count() == 0
