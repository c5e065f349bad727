"""What the first two stages of the pipeline leave on disk, and which of rows alike in id and text stays."""

from pathlib import Path

from strata import scratch
from strata.llm import importance, near_copies

SCHEMA = "doc_id long, text string, nth long"


def left(spark):
    top = Path(f"{scratch.shared_dir(spark)}/strata/{spark.sparkContext.applicationId}".removeprefix("file:"))
    return {p.parent for p in top.glob("*/*.parquet")}


def test_stages_leave_no_copy_of_the_texts(spark):
    docs = spark.createDataFrame([(i, f"text number {i // 2} of all those that are here", i) for i in range(40)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    before = left(spark)
    good, single = importance.keep_good(docs, labels), near_copies.drop_near_duplicates(docs)
    new = left(spark) - before
    assert sorted(p.name.rsplit("-", 1)[0] for p in new) == ["near-gone", "rejected"]
    assert all(kind == "bigint" or kind == "boolean" for p in new for _, kind in spark.read.parquet(str(p)).dtypes)
    assert single.count() == 20 and good.count() <= 40
    assert spark.conf.get(scratch.SHUFFLE_CLEANUP) == "false"


def test_first_of_rows_alike_stays(spark):
    rows = [(5, "one two three four five six", n) for n in range(50)] + [(6, "One two three four five six", 50), (None, "other", 51), (None, "other", 52), (None, "Other", 53)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert sorted(r.nth for r in near_copies.drop_near_duplicates(docs).collect()) == [0, 51]
