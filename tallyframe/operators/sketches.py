"""Profiles from mergeable sketches: made once a load, merged over loads, and an exact pass only over columns in doubt.

A load's profile is a row a column: counts, a HyperLogLog sketch of distinct values, and a frequent-items sketch. Sketches
are combined before the shuffle, so a load's distinct cells are never moved, and profiles of many loads merge into that of all. Estimates
carry bounds. What a profile decides about a column, whether it is a category or a unique identifier, is settled by the bounds where they
leave no doubt, and by counting that column alone where they do. Blank cells count as null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import profile

#: The logarithm of a distinct sketch's registers, and the share by which its estimate may be off: five standard errors.
REGISTERS, OFF = 14, 5 * 1.04 / 2**7
#: Values that a frequent-items sketch tracks, and by how much of all filled cells a count may be off.
ITEMS, MISSED = 2000, 2.625 / 2000
#: Distinct shares of filled cells and numbers of values at which a profile's decisions change.
SHARES, COUNTS = (0.1, 0.95), (1, 49)


def sketch_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A load's profile: ``pos, column, total_values, null_count, distinct, frequent``."""
    return profile.cells(df, columns).groupBy("pos", "column").agg(
        F.count("*").alias("total_values"), F.count_if(F.col("value").isNull()).alias("null_count"),
        F.hll_sketch_agg("value", REGISTERS).alias("distinct"),
        F.expr(f"approx_top_k_accumulate(value, {ITEMS}) filter (where value is not null)").alias("frequent"),
    )


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """The profile of all loads from the profiles of each, end to end."""
    return sketches.groupBy("pos", "column").agg(
        F.sum("total_values").alias("total_values"), F.sum("null_count").alias("null_count"), F.hll_union_agg("distinct").alias("distinct"),
        F.expr(f"approx_top_k_combine(frequent, {ITEMS})").alias("frequent"),
    )


def sketched_profile(sketches: DataFrame) -> DataFrame:
    """``pos, column_name, total_values, null_count, unique_values`` with ``unique_low`` and ``unique_high``, between which the number lies."""
    filled = F.col("total_values") - F.col("null_count")
    found = F.least(F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0)), filled)
    low = F.when(found > 0, F.greatest(F.lit(1), F.floor(found * (1 - OFF)))).otherwise(0)
    return sketches.select(
        "pos", F.col("column").alias("column_name"), "total_values", "null_count", found.alias("unique_values"),
        low.cast("long").alias("unique_low"), F.least(F.ceil(found * (1 + OFF)), filled).cast("long").alias("unique_high"),
    )


def sketched_top_values(sketches: DataFrame, k: int = 10) -> DataFrame:
    """``column, value, n, n_low``: the most frequent filled values; the true number is ``n`` or less, and ``n_low`` or more."""
    filled = F.col("total_values") - F.col("null_count")
    top = sketches.where(filled > 0).select("column", filled.alias("filled"), F.explode(F.expr(f"approx_top_k_estimate(frequent, {k})")).alias("x"))
    return top.select("column", F.col("x.item").alias("value"), F.col("x.count").alias("n"), F.greatest(F.lit(1), F.col("x.count") - F.ceil(F.col("filled") * MISSED)).cast("long").alias("n_low"))


def _decided(unique: Column, filled: Column) -> list[Column]:
    share = F.try_divide(unique, filled)
    category = (share < SHARES[0]) & (unique > COUNTS[0]) & (unique <= COUNTS[1])
    return [F.coalesce(category, F.lit(False)).alias("category"), F.coalesce((share > SHARES[1]) & (filled > 10), F.lit(False)).alias("unique_identifier")]


def settled_profile(df: DataFrame, sketches: DataFrame) -> DataFrame:
    """``sketched_profile`` with ``category, unique_identifier`` and ``exact``: as exact counts decide them.

    Columns between whose bounds a decision changes are counted in ``df``, which holds the rows of all sketched loads. The driver gets a row a column.
    """
    rows = sketched_profile(sketches).collect()
    doubtful = []
    for r in rows:
        filled = r.total_values - r.null_count
        edges = [*(s * filled for s in SHARES), *COUNTS]
        if any(r.unique_low <= e <= r.unique_high for e in edges) and r.unique_low < r.unique_high:
            doubtful.append(r.column_name)
    spark = df.sparkSession
    found = spark.createDataFrame(rows, "pos int, column_name string, total_values long, null_count long, unique_values long, unique_low long, unique_high long")
    counted = profile.profile_columns(df.select(*(F.col(f"`{c}`") for c in doubtful))) if doubtful else spark.createDataFrame([], "column_name string, unique_values long")
    found = found.join(counted.select("column_name", F.col("unique_values").alias("known")), "column_name", "left")
    exact = F.col("known").isNotNull() | (F.col("unique_low") == F.col("unique_high"))
    unique = F.coalesce("known", "unique_values")
    kept = [unique.alias("unique_values"), *(F.coalesce("known", c).alias(c) for c in ("unique_low", "unique_high"))]
    return found.select("pos", "column_name", "total_values", "null_count", *kept, *_decided(unique, F.col("total_values") - F.col("null_count")), exact.alias("exact"))
