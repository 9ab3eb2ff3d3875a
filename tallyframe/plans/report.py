"""The multi-source analysis and its relational report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import catalogue, grouping, multivalue, profile, reconcile, relate


def run_analysis(sources: dict[str, DataFrame], order_by: dict[str, Sequence[str]], words: list[str] | None = None, head: int | None = 100) -> dict[str, DataFrame]:
    """Results over all sources, lazy but for the columns: profiles, groupings, columns, tables, relationships, workflows, reconciliation, multi-value."""
    named = lambda f: [f(df).withColumn("table", F.lit(name)) for name, df in sources.items()]
    columns = catalogue.profile_catalogue(sources, order_by, head=head)
    tables = columns.groupBy("table", "source_type").agg(F.max("row_count").alias("row_count"))
    order = sources_order(columns.sparkSession, list(sources))
    tables = tables.join(order, "table")
    relationships = relate.detect_relationships(columns, tables)
    return {
        "profiles": union(named(profile.profile_columns)),
        "groupings": union(named(grouping.grouping_dimensions)),
        "columns": columns,
        "tables": tables,
        "relationships": relationships,
        "workflows": relate.detect_workflows(tables, columns, relationships),
        "reconciliation": reconcile.reconcile_all(sources) if len(sources) > 1 else None,
        "mismatches": reconcile.mismatches_all(sources) if len(sources) > 1 else None,
        "multi_value": multivalue.detect_multi_value(sources, words),
    }


def sources_order(spark, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "table string, pos int")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def report_tables(result: dict[str, DataFrame | None], mismatches: DataFrame | None = None, per_pair: int = 50) -> dict[str, DataFrame]:
    """The tables of a report; mismatch detail is the first rows of each pair, by key and column. ``mismatches``: others than the result's."""
    mismatches = result.get("mismatches") if mismatches is None else mismatches
    spark = result["columns"].sparkSession
    names = ("tables", "columns", "relationships", "workflows", "reconciliation", "multi_value", "groupings")
    out = {n: result[n] for n in names if result.get(n) is not None}
    counts = [df.agg(F.count("*").alias("count")).select(F.lit(n).alias("metric"), "count") for n, df in out.items()]
    out["summary"] = union(counts) if counts else spark.createDataFrame([], "metric string, count long")
    if "multi_value" in out:
        percent = lambda c: F.concat(F.bround(100 * F.col(c), 0).cast("int").cast("string"), F.lit("%"))
        out["multi_value"] = out["multi_value"].withColumn("confidence", percent("confidence")).withColumn("ratio", percent("ratio"))
    if mismatches is not None:
        first = Window.partitionBy("source1", "source2").orderBy("key_value", "column_name")
        out["mismatches"] = mismatches.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_pair).drop("place")
    return out
