"""Checks over unbounded tables.

The operators take batch DataFrames, and nothing in the library's scope is stream-only. ``checked_stream`` runs the
same checks on every micro-batch of a Structured Streaming source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyframe.operators.checks import Check, run_checks


def checked_stream(stream: DataFrame, table: str, checks: Sequence[Check], path: str) -> DataStreamWriter:
    """A writer that appends a row per check and micro-batch (``batch_id``) to Parquet at ``path``."""

    def check(batch: DataFrame, batch_id: int) -> None:
        results = run_checks({table: batch}, checks).withColumn("batch_id", F.lit(batch_id))
        # A batch that is run again after a failure overwrites its own folder.
        results.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(check)
