from datetime import datetime

from strata.functions.models import ModelRegistry
from strata.streaming.log_sink import LogSink


def test_model_registry(spark, tmp_path):
    models = ModelRegistry(spark, f"file://{tmp_path}/m")
    assert models.store("a", b"one", {"k": 1}, ["x"]) == 1 and models.store("a", b"two", {"k": 2}) == 2
    assert bytes(models.get("a").body) == b"two" and bytes(models.get("a", 1).body) == b"one"
    models.update("a", 2, ["y"])
    assert models.list("y").count() == 1
    models.delete("a", 1)
    assert models.get("a", 1) is None and models.list().count() == 1


def test_log_sink(spark, tmp_path):
    sink = LogSink(spark, f"file://{tmp_path}/log", most=2)
    for i in range(5):
        sink.emit(datetime(2026, 1, 1), "info", f"m{i}", n=str(i))
    sink.close()
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 5
