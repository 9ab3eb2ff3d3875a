"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task works on at once; larger texts are worked on alone.
SLICE_BYTES = 4 << 20
#: Bits, at most, of the test that leaves out rows before a join; past a tenth as many keys it leaves out fewer.
BITS = 1 << 28
#: Spark's setting by which a frame's shuffle files go when it has run.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests), a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found and context._jsc.sc().getCheckpointDir().isDefined():
        found = context._jsc.sc().getCheckpointDir().get()
    if not found and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Frames made inside give their shuffle files back as soon as each has run, not when the driver happens to collect garbage. Run each once."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder; what was shuffled on the way is freed."""
    checkpoint_dir(df.sparkSession)
    with freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose ``column`` holds ``limit`` bytes at most, or one row."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as a list, null as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def flat_utf8(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column end to end, and the ``rows + 1`` offsets of its rows; null is empty."""
    values = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def keep_rows(df: DataFrame, column: str, decide: Callable[[pa.RecordBatch], np.ndarray], limit: int = SLICE_BYTES) -> DataFrame:
    """The rows, with all their columns, for which ``decide`` is true; it sees ``limit`` bytes of ``column`` at a time."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                yield part.filter(pa.array(decide(part), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def maybe_in(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that holds for all values of ``key``, and for few others: a bit a hash, ``BITS`` at most, so that a join shuffles few rows in vain."""
    size = min(BITS, 63 + 10 * keys.count())
    place = F.pmod(F.xxhash64(key), F.lit(size))
    with freed(keys.sparkSession):
        found = keys.select(place.alias("b")).groupBy(F.floor(F.col("b") / 63).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 63 as int))")).alias("v")).toArrow()
    bits = np.zeros(size // 63 + 1, dtype=np.int64)
    bits[found["w"].to_numpy()] = found["v"].to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def holds(b: pa.Array) -> pa.Array:
        w, at = np.divmod(b.to_numpy(zero_copy_only=False), 63)
        return pa.array((shared.value[w] >> at & 1) == 1)

    return lambda c: c.isNotNull() & holds(F.pmod(F.xxhash64(c), F.lit(size)))


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns as ``doc_id`` long and ``text`` string, whatever else the frame holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): a bijection that spreads every input bit."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64, copy=True)
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        return z
