"""Audit checks: aggregates, assertions on values and rows, roll-ups, findings, nested plans.

A ``Check`` is a small object; ``run_checks`` turns those on one table into one aggregation and gives a row per
check. A check that fails to analyse or to run is an error row and doesn't stop the others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import predicates as p
from tallyframe.operators import catalogue

RESULT = "label string, passed boolean, lhs_value string, op string, rhs_value string, source_col string, error string"
#: Comparisons of a check by their sign.
OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {"=": p.eq, "!=": p.ne, ">": p.gt, ">=": p.ge, "<": p.lt, "<=": p.le}


def _where(c: Column, where: Column | None) -> Column:
    return c if where is None else F.when(p._false(where), c)


def check_sum(c: Column, where: Column | None = None, distinct: bool = False) -> Column:
    """The sum of non-null cells, 0 if there are none."""
    v = _where(c, where)
    return F.coalesce(F.sum_distinct(v) if distinct else F.sum(v), F.lit(0))


def check_avg(c: Column, where: Column | None = None, distinct: bool = False) -> Column:
    v = _where(c.cast(p.NUMBER), where)
    return F.sum_distinct(v) / F.countDistinct(v) if distinct else F.try_divide(F.sum(v), F.count(v))


def check_count(c: Column, where: Column | None = None, distinct: bool = False) -> Column:
    v = _where(c, where)
    return F.countDistinct(v) if distinct else F.count(v)


def check_min(c: Column, where: Column | None = None) -> Column:
    return F.min(_where(c, where))


def check_max(c: Column, where: Column | None = None) -> Column:
    return F.max(_where(c, where))


def countif(c: Column, value: Column | None = None) -> Column:
    return F.count(c) if value is None else F.count_if(p.eq(c, value))


def sumif(c: Column, value: Column | None = None, sum_col: Column | None = None) -> Column:
    target = c if sum_col is None else sum_col
    return check_sum(target, None if value is None else p.eq(c, value))


def with_scalars(df: DataFrame, source: DataFrame, **aggregates: Column) -> DataFrame:
    """Rows of ``df`` beside aggregates over ``source``, for predicates that use both; the aggregate is one row."""
    return df.join(F.broadcast(source.agg(*(c.alias(n) for n, c in aggregates.items()))))


@dataclass(frozen=True)
class Check:
    """``lhs`` is an aggregate compared with ``rhs`` by ``op``; or ``predicate`` must hold on every row."""

    label: str
    table: str
    lhs: Column | None = None
    op: str = "="
    rhs: Column | None = None
    predicate: Column | None = None
    source_col: str | None = None


def assert_value(df: DataFrame, check: Check) -> DataFrame:
    one = df.agg(check.lhs.alias("l"), check.rhs.alias("r") if check.rhs is not None else F.lit(True).alias("r"))
    return one.select(
        F.lit(check.label).alias("label"), OPERATIONS[check.op](F.col("l"), F.col("r")).alias("passed"), F.col("l").cast("string").alias("lhs_value"),
        F.lit(check.op).alias("op"), F.col("r").cast("string").alias("rhs_value"), F.lit(check.source_col).cast("string").alias("source_col"),
    )


def assert_rows(df: DataFrame, predicate: Column, label: str, source_col: str | None = None) -> DataFrame:
    """``label, passed, lhs_value`` (rows that pass) ``, op, rhs_value`` (all rows); an empty table passes."""
    one = df.agg(F.count_if(p._false(predicate)).alias("l"), F.count("*").alias("r"))
    return one.select(
        F.lit(label).alias("label"), (F.col("l") == F.col("r")).alias("passed"), F.col("l").cast("string").alias("lhs_value"), F.lit("/").alias("op"),
        F.col("r").cast("string").alias("rhs_value"), F.lit(source_col).cast("string").alias("source_col"),
    )


def failing_rows(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(~p._false(predicate))


def _fused(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All checks of one table in one aggregation."""
    sums, rows = [], []
    for i, c in enumerate(checks):
        if c.predicate is not None:
            sums += [F.count_if(p._false(c.predicate)).alias(f"l{i}"), F.count("*").alias(f"r{i}")]
            passed, op = F.col(f"l{i}") == F.col(f"r{i}"), "/"
        else:
            sums += [c.lhs.alias(f"l{i}"), (c.rhs if c.rhs is not None else F.lit(True)).alias(f"r{i}")]
            passed, op = OPERATIONS[c.op](F.col(f"l{i}"), F.col(f"r{i}")), c.op
        rows.append(F.struct(
            F.lit(c.label).alias("label"), passed.alias("passed"), F.col(f"l{i}").cast("string").alias("lhs_value"), F.lit(op).alias("op"),
            F.col(f"r{i}").cast("string").alias("rhs_value"), F.lit(c.source_col).cast("string").alias("source_col"), F.lit(None).cast("string").alias("error"),
        ))
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def run_checks(frames: dict[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """One row per check. The checks of a table run together; if that fails, one by one, errors as rows."""
    first = next(iter(frames.values()))
    spark, results = first.sparkSession, []
    for table in dict.fromkeys(c.table for c in checks):
        own = [c for c in checks if c.table == table]
        if table not in frames:
            results += [(c.label, None, None, None, None, c.source_col, f"unknown table: {table}") for c in own]
            continue
        try:
            results += [tuple(r) for r in _fused(frames[table], own).collect()]  # a row a check
        except PySparkException:
            for c in own:
                try:
                    results += [tuple(r) for r in _fused(frames[table], [c]).collect()]
                except PySparkException as e:
                    results.append((c.label, None, None, None, None, c.source_col, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(results, RESULT)


def check_rollup(results: DataFrame) -> DataFrame:
    """``script, passed, failed, errors`` per script, and their total as script null."""
    counts = [
        F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed") & F.col("error").isNull()).alias("failed"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    ]
    by_script = results.groupBy("script").agg(*counts)
    total = by_script.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("passed", "failed", "errors")))
    return by_script.unionByName(total.withColumn("script", F.lit(None).cast("string")).select("script", "passed", "failed", "errors"))


def script_outcome(results: DataFrame) -> DataFrame:
    """``script, outcome, exceptions``: the first assertion decides; else the first error; else the first value or sample."""
    kind = F.when(F.col("error").isNotNull(), "error").when(F.col("passed").isNotNull(), "assertion").otherwise("value")
    r = results.withColumn("kind", kind)
    first = lambda k, what: F.min_by(F.when(F.col("kind") == k, what), F.when(F.col("kind") == k, F.col("pos")))
    found = r.groupBy("script").agg(
        first("assertion", F.when(F.col("passed"), "passed").otherwise("failed")).alias("a"), first("error", F.concat(F.lit("error: "), "error")).alias("e"),
        first("value", F.concat(F.lit("value: "), F.coalesce("lhs_value", F.lit("")))).alias("v"),
        F.count_if((F.col("kind") == "assertion") & ~F.col("passed")).alias("exceptions"),
    )
    return found.select("script", F.coalesce("a", "e", "v").alias("outcome"), "exceptions")


def findings(scripts: DataFrame, results: DataFrame, controls: DataFrame) -> DataFrame:
    """``script, ref, objective, risk, failing`` of scripts with failed or erroneous checks; risk is Medium by default."""
    bad = results.where((F.col("passed") == F.lit(False)) | F.col("error").isNotNull())
    labels = bad.groupBy("script").agg(F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("failing"))
    found = scripts.join(labels, "script").join(controls, "ref", "left")
    return found.select("script", "ref", "objective", F.coalesce("risk", F.lit("Medium")).alias("risk"), "failing")


def passed_refs(scripts: DataFrame, results: DataFrame) -> DataFrame:
    bad = results.where((F.col("passed") == F.lit(False)) | F.col("error").isNotNull()).select("script")
    return scripts.join(bad, "script", "left_anti").select("ref").distinct()


def evidence_distribution(results: DataFrame, df: DataFrame, columns: Sequence[str], k: int = 50) -> DataFrame:
    """``column, value, n`` of the columns that failed assertions name; ``columns`` are those the caller may read."""
    failed = results.where(F.col("passed") == F.lit(False)).select(F.lower("source_col").alias("column")).distinct()
    out = None
    for c in columns:
        part = catalogue.column_distribution(df, c, k).select(F.lit(c.lower()).alias("column"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out.join(failed, "column", "left_semi")


def nest(parents: DataFrame, children: DataFrame, key: str, order: str, name: str = "children") -> DataFrame:
    """Parents with their children as an array of structs in ``order``; a parent without any has an empty one."""
    fields = [c for c in children.columns if c != key]
    row = F.struct(F.col(order).alias("__order"), *[c for c in fields if c != order])
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array()))


def group_title(first_item: Column, objective: Column, ref: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(first_item), blank(objective), ref)


def approval_rollup(items: DataFrame) -> DataFrame:
    """``control, total, approved, sql_items, csv_items`` per control, and overall as control null."""
    counts = [
        F.count("*").alias("total"), F.count_if("approved").alias("approved"), F.count_if(F.upper("item_type") == "SQL").alias("sql_items"),
        F.count_if(F.upper("item_type") == "CSV").alias("csv_items"),
    ]
    by_control = items.groupBy("control").agg(*counts)
    overall = by_control.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total", "approved", "sql_items", "csv_items")))
    return by_control.unionByName(overall.withColumn("control", F.lit(None).cast("string")).select("control", "total", "approved", "sql_items", "csv_items"))
