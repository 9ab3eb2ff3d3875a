"""Checks on micro-batches equal checks on the batch."""

from pyspark.sql import functions as F

from tallyframe.operators.checks import Check, check_sum
from tallyframe.streaming import checked_stream


def test_checks_on_micro_batches(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").symlink_to(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    check = Check("ids", "events", check_sum(F.col("event_id")), ">=", F.lit(0))
    query = checked_stream(stream, "events", [check], str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out" / "batch=*")).collect()
    assert [(r.label, r.passed, r.batch_id) for r in rows] == [("ids", True, 0)]
