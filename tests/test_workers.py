"""The background worker of a projection."""

import time

from strata.streaming.streams import Projection


def test_worker_polls_and_goes_on_after_a_restart(spark, tmp_path):
    seen = []
    folder = f"{tmp_path}/events"
    spark.range(0, 5).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema("id long").parquet(folder)
    worker = Projection("ids", lambda batch, _: seen.extend(r.id for r in batch.collect()), f"{tmp_path}/checkpoint")

    def wait(query, n):
        end = time.time() + 60
        while len(seen) < n and time.time() < end:
            time.sleep(0.2)
        query.stop()

    wait(worker.start(stream(), "100 milliseconds"), 5)
    assert sorted(seen) == [0, 1, 2, 3, 4]
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(folder)
    wait(worker.start(stream(), "100 milliseconds"), 8)
    assert sorted(seen) == list(range(8))
