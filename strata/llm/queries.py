"""The operators of this subpackage over their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, hash_tree, importance, mixing, pii, records, simhash, wordpiece

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the resampling draws."""
    drawn = importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return drawn.where("kept").select(F.col("id").alias("doc_id"), "log_weight", "kept")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(_read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = records.export_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_read(spark, sf_dir, "documents"), window=None)
    ranks = F.transform("base", lambda x: x["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, k))).cast("long").alias(f"n_{pii.KINDS[k]}") for k in range(4)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.listing(F.col("base")), 256).alias("base_sha256"), pii.listing(pii.all_spans()).alias("spans"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what the formatted conversations hold."""
    for batch in batches:
        out = []
        for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = chat.parse(text)
            spoken = "".join(chat.unescape(text[x["start"] : x["end"]]) for x in loss)
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, spoken)]
            out.append((len(turns), digests[0], len(spoken), digests[1], len(text)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        cols = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    formatted = chat.format_conversations(turns.unionByName(probe)).select("conv_id", "formatted", "loss")
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(_read_back, kinds)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, grown = hash_tree.uniform_tree(24), hash_tree.uniform_tree(25)
    return hash_tree.assign_shards(_read(spark, sf_dir, "documents"), tree, grown)


QUERIES: dict[str, Query] = {
    "op1_importance": op1_importance,
    "op2_simhash": op2_simhash,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mixing": op4_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_records": op6_records,
    "op7_decontamination": op7_decontamination,
    "op8_pii": op8_pii,
    "op9_chat": op9_chat,
    "op10_sharding": op10_sharding,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS len,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents),
        w AS (
          SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY norm) AS group_size
          FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
    """,
    "op7_decontamination": r"""
        WITH words AS (
          SELECT 'd' AS side, doc_id AS id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents
          UNION ALL
          SELECT 'i', min(item_id), string_split(norm, ' ') FROM (
            SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM benchmark) GROUP BY norm),
        places AS (SELECT side, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM words WHERE w <> ['']),
        shingles AS (SELECT DISTINCT side, id, array_to_string(w[p:p + 4], ' ') AS s FROM places),
        items AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE side = 'i')
        SELECT d.id AS doc_id, i.item_id, i.n AS n_shingles, count(*) AS n_shared, count(*) / i.n AS containment
        FROM shingles d JOIN items i ON d.s = i.s WHERE d.side = 'd'
        GROUP BY d.id, i.item_id, i.n HAVING count(*) >= ceil(0.8 * i.n - 1e-9)
    """,
    "op9_chat": r"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        c AS (
          SELECT conv_id, count(*) AS n_turns,
                 string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
                 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS spoken,
                 CAST(sum(13 + length(regexp_replace(role, '[\\#<\n]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g'))) AS BIGINT) AS formatted_chars
          FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(spoken) AS loss_chars,
               sha256(spoken) AS loss_sha256, formatted_chars FROM c
    """,
}
