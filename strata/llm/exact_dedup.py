"""Exact dedup by skew-safe combining, with DataFrame functions only.

Texts are equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted. Three combining stages, each comparing whole
normalised texts (the text is part of every grouping key, the digest only puts
equal texts in one place):

1. *local*: rows are salted by their task, so the map side of the first aggregation leaves one row per
   text and task, and copies inside a task never travel;
2. *salted*: those rows meet by (digest, salt, text); a group that holds a third of
   all rows is spread over ``salts`` tasks;
3. *global*: the at most ``salts`` winners of each text meet by (digest, text).

Whole texts are shuffled twice, as distinct texts per task and per salt. The
outcome then goes back to the documents through narrow rows (row number, id, digest), by
(digest, salt) with a salt drawn from the row's number, so rows that repeat an id or have none spread like any others.
That last lookup goes by SHA-256, a second 64-bit hash and
the length; if two different texts ever shared all three, the query fails
loudly and never merges them.

Defined results: a null text is the empty text. A null id ranks after all
others and is never preferred. Rows that repeat both the id and the text of the row that
stays are copies as well: exactly one of them has ``kept`` true. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh
from ..scratch import materialize

#: Characters that do not count, for a Java regular expression.
BLANKS = r"[\x20\x09-\x0D]+"
_SHIFT = 10**20
_TOP = 10**19


def _big(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def _rank(length: Column, doc_id: Column) -> Column:
    """Longest first, then the smallest id, then null ids: one number, so that a hash aggregate can hold it."""
    by_id = F.coalesce(_big(_TOP) - doc_id.cast("decimal(20,0)"), _big(0))
    return (length.cast("decimal(38,0)") * _big(_SHIFT).cast("decimal(21,0)") + by_id).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    by_id = rank % _big(_SHIFT)
    return F.when(by_id == 0, F.lit(None)).otherwise(_big(_TOP) - by_id).cast("long")


def _outcome(rows: DataFrame, salts: int) -> DataFrame:
    """row, id, t -> row, id, best (the rank of the row that stays), n, kept, dig."""
    rows = rows.select("row", "id", F.length("t").alias("len"), F.regexp_replace("t", BLANKS, "").alias("norm"))
    rows = rows.withColumn("dig", F.unhex(F.sha2("norm", 256)))
    key = ["dig", "tag", "tag_len"]
    tag = [F.xxhash64("norm").alias("tag"), F.length("norm").alias("tag_len")]
    salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt")
    narrow = materialize(rows.select("row", "id", "len", "dig", *tag, salt), "exact-rows")

    rank = _rank(F.col("len"), F.col("id"))
    task = rows.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = task.groupBy("dig", "task", "norm").agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("best"))
    whole = salted.groupBy("dig", "norm").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
    texts = F.when(F.count(F.lit(1)) == 1, F.max("n")).otherwise(F.raise_error(F.lit("different texts share a digest")))
    outcome = whole.select("dig", *tag, "n", "best").groupBy(*key).agg(texts.cast("long").alias("n"), F.max("best").alias("best"))

    by_salt = narrow.groupBy(*key, "salt").agg(F.max(F.struct(rank.alias("best"), (-F.col("row")).alias("first"))).alias("top"))
    stays = by_salt.groupBy(*key).agg((-F.max("top")["first"]).alias("stays"))
    found = narrow.join(by_salt.select(*key, "salt").join(outcome.join(stays, key), key), [*key, "salt"])
    return found.select("row", "id", "best", "n", (F.col("row") == F.col("stays")).alias("kept"), "dig")


def _rows(docs: DataFrame, row: Column, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("t"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. See the module's docstring."""
    found = _outcome(_rows(docs, F.monotonically_increasing_id(), id_col, text_col), salts)
    return found.select(
        F.col("id").alias("doc_id"),
        _id_of(F.col("best")).alias("keep_id"),
        F.col("n").alias("group_size"),
        "kept",
        F.lower(F.hex("dig")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The documents that stay, one row of each text, with their own columns."""
    row = fresh(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "exact-docs")
    stay = _outcome(_rows(numbered, F.col(row), id_col, text_col), salts).where("kept").select(F.col("row").alias(row))
    return numbered.join(stay, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
