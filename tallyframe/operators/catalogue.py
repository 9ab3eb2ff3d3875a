"""Column catalogues: inferred types, key tests, samples, distributions, profiles of many tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import text as tx
from tallyframe.operators import profile

#: The texts that each kind of source reads as booleans.
BOOLEANS = {
    "csv": ("true", "false", "yes", "no", "1", "0", "t", "f", "y", "n"),
    "flat": ("true", "false", "yes", "no", "1", "0"),
    "workbook": ("true", "false", "yes", "no", "1", "0", "t", "f"),
}


def infer_types(df: DataFrame, dialect: str = "csv") -> DataFrame:
    """``column, data_type, max_length`` (for texts) from all filled cells; a column without any is Boolean."""
    v = tx.trim_ws(F.col("value"))
    sign = v.contains("/") | v.contains("-")
    date = {"csv": sign & v.rlike("[0-9]"), "workbook": sign, "flat": F.lit(False)}[dialect]
    all_ = lambda c: F.coalesce(F.every(c), F.lit(True))
    found = profile.cells(df).where("value is not null").groupBy("pos").agg(
        all_(F.lower(v).isin(*BOOLEANS[dialect])).alias("boolean"), all_(tx.is_integer_text(v)).alias("whole"),
        all_(tx.is_numeric_text(v)).alias("number"), all_(date).alias("date"), F.max(F.octet_length(v)).alias("longest"),
    )
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "pos int, column string")
    found = names.join(found, "pos", "left")
    longest = F.coalesce("longest", F.lit(0))
    whole = F.when(longest <= 3, "SmallInt").when(longest <= 10, "Integer").otherwise("BigInt") if dialect == "csv" else F.lit("Integer")
    dated = F.col("date") & (longest <= 30) if dialect == "csv" else F.col("date")
    kind = (
        F.when(F.coalesce("boolean", F.lit(True)), "Boolean").when(F.col("whole"), whole).when(F.col("number"), "Float")
        .when(dated, "DateTime").when(longest <= 255, "VarChar").otherwise("Text")
    )
    return found.select("column", kind.alias("data_type"), F.when(kind == "VarChar", F.greatest(longest, F.lit(50))).alias("max_length"))


def potential_keys(df: DataFrame, approx: bool = False) -> DataFrame:
    """``column, unique_count, null_count, is_key``: a key has no blank cell and no value twice (trimmed)."""
    v = tx.trim_ws(F.col("value"))
    count = F.approx_count_distinct(v) if approx else F.countDistinct(v)
    found = profile.cells(df).groupBy("column").agg(count.alias("unique_count"), F.count_if(F.col("value").isNull()).alias("null_count"), F.count("*").alias("n"))
    return found.select("column", "unique_count", "null_count", ((F.col("null_count") == 0) & (F.col("unique_count") == F.col("n"))).alias("is_key"))


def sample_values(df: DataFrame, n: int = 5) -> DataFrame:
    """``column, value``: the n smallest distinct filled values of each column."""
    values = profile.cells(df).where("value is not null").select("column", "value").distinct()
    return values.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("place") <= n).drop("place")


def column_distribution(df: DataFrame, column: str, k: int = 50) -> DataFrame:
    """``value, n``: blank and null cells as empty, most frequent first, the first k."""
    name = next((c for c in df.columns if c.lower() == column.lower()), column)
    counts = df.groupBy(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def profile_catalogue(frames: dict[str, DataFrame], order_by: dict[str, Sequence[str]], source_type: str = "csv", head: int | None = 100) -> DataFrame:
    """The columns catalogue of many tables: ``table, pos, column, unique_count, null_count, is_pk, is_fk, row_count, source_type``.

    It is made at once and kept on the driver: a row a column. What is built on it reads no table. Whole columns (``head`` None) of all
    tables are counted in one job, and only columns whose counts leave open whether they are keys are sorted.
    """
    if head is None:
        found = profile.keys_of_all(frames, order_by)
    else:
        found = None
        for name, df in frames.items():
            part = profile.column_keys(df, order_by[name], head).withColumn("table", F.lit(name))
            found = part if found is None else found.unionByName(part)
    out = found.select(
        "table", "pos", F.col("column_name").alias("column"), F.col("unique_values").alias("unique_count"), "null_count",
        F.col("is_key").alias("is_pk"), F.lit(False).alias("is_fk"), F.col("total_values").alias("row_count"), F.lit(source_type).alias("source_type"),
    )
    return out.sparkSession.createDataFrame(out.collect(), out.schema)
