"""Statistical samples: random, systematic, monetary-unit and stratified. Each is repeatable by its seed or start."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.sources.files import numbered, prefix_sums


def sample_size(population: int, n: int | None = None, percent: float | None = None) -> int:
    """A count, or a share rounded up, within 1 and the population."""
    size = n if n is not None else max(1, math.ceil((percent or 0) / 100 * population))
    if size < 1 or population < 1:
        raise ValueError("a sample needs a population and at least one row")
    return min(size, population)


def sample_random(df: DataFrame, n: int | None = None, seed: int = 0, percent: float | None = None, key: Sequence[str] | None = None) -> DataFrame:
    """n rows without replacement: those with the smallest hash of key and seed, so partitioning doesn't matter."""
    size = sample_size(df.count(), n, percent)
    columns = list(key or df.columns)
    return df.orderBy(F.xxhash64(F.lit(seed), *columns), *columns).limit(size)


#: The hash of a row's cells, which tells apart rows that share a place in the order.
ROW = "__cells_hash"


def _places(df: DataFrame, order_by: Sequence[str], *more) -> DataFrame:
    """Of each row its order, the hash of all its cells, and ``more``: what a sample is chosen by, without the row."""
    return df.select(*(F.col(c).alias(f"__o{i}") for i, c in enumerate(order_by)), F.xxhash64(*df.columns).alias(ROW), *more)


def _fetch(df: DataFrame, order_by: Sequence[str], chosen: DataFrame) -> DataFrame:
    """The rows of the chosen places, each as often as it was chosen, with the other columns of ``chosen``.

    Rows with equal order and cells are one place, so that any of them stands for all. Only the chosen rows are shuffled.
    """
    keys = [*(f"__o{i}" for i in range(len(order_by))), ROW]
    wanted = chosen.select(*(F.col(k).alias(f"{k}w") for k in keys)).distinct()
    same = lambda a, b: [F.col(k + a).eqNullSafe(F.col(k + b)) for k in keys]
    placed = df.select(F.struct(*df.columns).alias("__cells"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order_by)), F.xxhash64(*df.columns).alias(ROW))
    rows = placed.join(wanted, same("", "w"), "left_semi").groupBy(*keys).agg(F.any_value("__cells").alias("__cells"))
    rows = rows.select("__cells", *(F.col(k).alias(f"{k}r") for k in keys))
    more = [c for c in chosen.columns if c not in keys]
    return chosen.join(rows, same("", "r")).select("__cells.*", *more)


def sample_systematic(df: DataFrame, n: int | None, order_by: Sequence[str], start: int | None = None, seed: int = 0, percent: float | None = None) -> DataFrame:
    """Every k-th row in order, k the whole part of population / n, from ``start`` (by the seed, if not given).

    Rows that share a place in the order are ordered by a hash of their cells. Only places are numbered; the chosen rows are read again.
    """
    population = df.count()
    size = sample_size(population, n, percent)
    if size >= population:
        return df
    step = population // size
    first = (seed * 2654435761 % step if start is None else start) % step
    places = _places(df, order_by)
    at = F.col("__at") - first
    chosen = numbered(places, places.columns, "__at").where((at >= 0) & (at % step == 0) & (at / step < size)).drop("__at")
    return _fetch(df, order_by, chosen)


def sample_mus(df: DataFrame, value: str, n: int, order_by: Sequence[str], start: int | None = 0, seed: int | None = None) -> DataFrame:
    """Monetary-unit sample: n thresholds at equal steps of the running total of positive values.

    Values are summed exactly, to the scale of a decimal column, or to ten digits after the point of another number. A row
    is given once for each threshold in it (column ``hit`` from 0). ``start`` lies in the first step; a ``seed`` chooses it.
    Without a positive total it falls back on ``sample_random``; ``method`` says which it was. Rows that share a place in the
    order are ordered by a hash of their cells. Only places and values are added up; the chosen rows are read again.
    """
    if n < 1:
        raise ValueError("a sample needs at least one row")
    kind = df.schema[value].dataType
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0 if isinstance(kind, T.IntegralType) else 10
    units = (F.col(value).cast(f"decimal(28,{scale})") * 10**scale).cast("decimal(38,0)")
    positive = df.where(F.col(value) > 0)
    total = positive.agg(F.sum(units)).first()[0]
    if not total:
        return sample_random(df, n).withColumn("hit", F.lit(0)).withColumn("method", F.lit("random"))
    first = int((start or 0) * 10**scale) if seed is None else seed * 2654435761 % max(1, int(total) // n)
    places = _places(positive, order_by, units.alias("__v"))
    summed = prefix_sums(places, "__v", [c for c in places.columns if c != "__v"], "__to", kind="decimal(38,0)")
    # How many of the thresholds first + k * total / n are below x, in whole numbers.
    below = lambda x: F.expr(f"cast(least(greatest((cast({x} - {first} as decimal(38,0)) * {n} + {int(total) - 1}) div {int(total)}, 0), {n}) as int)")
    summed = summed.withColumn("__a", below("(__to - __v)")).withColumn("__b", below("__to"))
    hits = summed.where("__b > __a").withColumn("hit", F.explode(F.sequence(F.lit(0), F.col("__b") - F.col("__a") - 1)))
    return _fetch(positive, order_by, hits.drop("__a", "__b", "__to", "__v")).withColumn("method", F.lit("mus"))


def sample_stratified(df: DataFrame, value: str, n: int, order_by: Sequence[str], seed: int = 0) -> DataFrame:
    """The max(1, n // 2) largest rows by value, and a random rest; ``stratum`` says which.

    Largest first, then by ``order_by``, which may hold nulls and repeats, then by all columns, so rows that share a place are
    alike. Each task keeps a heap of the first rows; nothing is sorted as a whole. The driver gets the last of the largest rows.
    """
    size = sample_size(df.count(), n)
    top_n = max(1, size // 2)
    order = ["__by", *order_by, *(c for c in df.columns if c not in order_by)]
    keyed = df.withColumn("__by", -F.coalesce(F.col(value).try_cast("double"), F.lit(0.0)))
    top = keyed.orderBy(*order).limit(top_n)
    out = top.withColumn("stratum", F.lit("top"))
    if size > top_n:
        last = top.groupBy(*order).agg(F.count("*").alias("__taken")).orderBy(*(F.col(c).desc_nulls_last() for c in order)).first()
        taken, least = last["__taken"], {c: F.lit(last[c]).cast(keyed.schema[c].dataType) for c in order}
        # Rows after the last of the largest, and those alike it, of which some are among the largest.
        after, alike = F.lit(False), F.lit(True)
        for c in order:
            later = F.coalesce(F.col(c) > least[c], F.col(c).isNotNull() & least[c].isNull())
            after, alike = after | (alike & later), alike & F.col(c).eqNullSafe(least[c])
        hashed = [F.xxhash64(F.lit(seed), *order_by), *order_by, *order]
        rest = keyed.where(after | alike).orderBy(*hashed).limit(size - top_n + taken)
        copy = F.row_number().over(Window.partitionBy(alike.alias("__alike")).orderBy(F.lit(0)))  # a sample's rows at most
        rest = rest.withColumn("__copy", F.when(alike, copy).otherwise(taken + 1)).where(F.col("__copy") > taken).drop("__copy")
        out = out.unionByName(rest.orderBy(*hashed).limit(size - top_n).withColumn("stratum", F.lit("random")))
    return out.drop("__by")
