"""Grouping dimensions: groups of composite cells, sizes, types, hierarchies, suggested analyses, group keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import text as tx
from tallyframe.sources.files import named_groups

#: Name parts of each type of dimension, in the order in which they are tried.
DIMENSION_NAMES = {
    "Temporal": ("date", "time", "year", "month", "day"),
    "Geographic": ("country", "state", "city", "region", "location"),
    "Identifier": ("id", "customer", "user", "product", "order"),
    "Categorical": ("status", "type", "category", "class"),
}
#: Name parts of measures, and of the columns that may form a categorical hierarchy.
MEASURE_NAMES = ("amount", "price", "quantity", "count", "total", "value")
CATEGORY_NAMES = ("category", "type", "class")
#: Most groups of a dimension.
MOST_GROUPS = 1000


def group_values(c: Column) -> Column:
    """The groups of a cell: its parts if there are several, else the raw value; an empty cell has none."""
    parts = tx.composite_parts(c)
    return F.when(tx.text(c) == "", F.array().cast("array<string>")).when(F.size(parts) > 1, parts).otherwise(F.array(c.cast("string")))


def explode_groups(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, F.explode(group_values(F.col(f"`{column}`"))).alias("group"))


def all_groups(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``pos, column, group`` rows of all columns, from one scan."""
    chosen = list(columns or df.columns)
    # Each cell is split once, before it is asked how many parts it has.
    split = df.select(*keep, *(x for i, c in enumerate(chosen) for x in (tx.text(F.col(f"`{c}`")).alias(f"__t{i}"), tx.composite_parts(F.col(f"`{c}`")).alias(f"__p{i}"))))
    groups = lambda i: F.when(F.col(f"__t{i}") == "", F.array().cast("array<string>")).when(F.size(f"__p{i}") > 1, F.col(f"__p{i}")).otherwise(F.array(f"__t{i}"))
    cells = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), groups(i).alias("groups")) for i, c in enumerate(chosen)]
    rows = split.select(*keep, F.explode(F.array(*cells)).alias("x"))
    return rows.select(*keep, "x.pos", "x.column", F.explode("x.groups").alias("group"))


def group_sizes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return all_groups(df, columns).groupBy("pos", "column", "group").agg(F.count("*").alias("n"))


def size_stats(sizes: DataFrame) -> DataFrame:
    """``pos, column, group_count, min, max, avg, median, total`` of group sizes; the upper median.

    The median is read from counts of sizes, of which there are at most as many as the root of the rows.
    """
    by_size = sizes.groupBy("pos", "column", "n").agg(F.count("*").alias("groups"))
    order = Window.partitionBy("pos").orderBy("n")
    placed = by_size.withColumn("upto", F.sum("groups").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("all", F.sum("groups").over(Window.partitionBy("pos")))
    return placed.groupBy("pos", "column").agg(
        F.sum("groups").alias("group_count"), F.min("n").alias("min"), F.max("n").alias("max"),
        (F.sum(F.col("n") * F.col("groups")) / F.sum("groups")).alias("avg"),
        F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("median"),
        F.sum(F.col("n") * F.col("groups")).alias("total"),
    )


def group_size_stats(df: DataFrame, column: str) -> DataFrame:
    return size_stats(group_sizes(df, [column])).drop("pos")


def grouping_dimensions(df: DataFrame) -> DataFrame:
    """``size_stats`` of the columns with 1 to ``MOST_GROUPS`` groups.

    A sketch of each column's groups, combined before the shuffle, shows first which columns have far more (twice as many, some 60
    standard errors away); only the others are counted. The driver gets a number a column.
    """
    sketched = all_groups(df).groupBy("pos").agg(F.hll_sketch_estimate(F.hll_sketch_agg("group", 14)).alias("groups")).collect()
    few = sorted(r.pos for r in sketched if 1 <= r.groups <= 2 * MOST_GROUPS)
    if not few:
        return size_stats(group_sizes(df)).where("false")
    found = size_stats(group_sizes(df, [df.columns[i] for i in few])).where(F.col("group_count").between(1, MOST_GROUPS))
    return found.withColumn("pos", F.element_at(F.array(*map(F.lit, few)), F.col("pos") + 1))


def group_examples(df: DataFrame, row_no: str, groups: int = 5, rows: int = 3, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, group, n, rows``: each dimension's largest groups with their first row numbers, comma-joined."""
    chosen = [c for c in (columns or df.columns) if c != row_no]
    sizes = group_sizes(df, chosen)
    order = Window.partitionBy("pos").orderBy(F.desc("n"), "group")
    top = sizes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= groups)
    members = all_groups(df, chosen, [row_no]).join(F.broadcast(top.select("pos", "group", "n")), ["pos", "group"])  # a few rows a column
    # Each task keeps a group's first rows before the shuffle; a row that is in a group twice has one rank.
    rank = F.dense_rank().over(Window.partitionBy("column", "group").orderBy(row_no))
    first = members.select("column", "group", "n", row_no).withColumn("at", rank).where(F.col("at") <= rows).drop("at").distinct()
    return first.groupBy("column", "group", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row_no)), lambda x: x.cast("string")), ",").alias("rows"))


def dimension_type(column: Column, hierarchical: Column) -> Column:
    """By the column's name; else by whether an example holds ``/`` or ``>``."""
    name, out = F.lower(column), None
    for kind, parts in DIMENSION_NAMES.items():
        found = name.rlike("|".join(parts))
        out = F.when(found, kind) if out is None else out.when(found, kind)
    return out.when(hierarchical, "Hierarchical").otherwise("Categorical")


def typed_dimensions(df: DataFrame) -> DataFrame:
    """``grouping_dimensions`` with ``type``; the examples are the five largest groups."""
    sizes = group_sizes(df)
    order = Window.partitionBy("pos").orderBy(F.desc("n"), "group")
    top = sizes.withColumn("place", F.row_number().over(order)).where("place <= 5")
    signs = top.groupBy("pos").agg(F.some(F.col("group").rlike("[/>]")).alias("hierarchical"))
    dims = size_stats(sizes).where(F.col("group_count").between(1, MOST_GROUPS)).join(signs, "pos")
    return dims.withColumn("type", dimension_type(F.col("column"), F.col("hierarchical"))).drop("hierarchical")


def dimension_insights(dimensions: DataFrame) -> DataFrame:
    """``column, groups, records, distribution, kind`` of typed dimensions."""
    spread = F.when(F.col("max") > 3 * F.col("avg"), "uneven").otherwise("even")
    kind = F.when(F.col("type") == "Temporal", "trend").when(F.col("type") == "Identifier", "per_entity").when(F.col("type") == "Categorical", "compare").when(F.col("type") == "Geographic", "regional")
    return dimensions.select("column", F.col("group_count").alias("groups"), F.col("total").alias("records"), spread.alias("distribution"), kind.alias("kind"))


def temporal_hierarchy(dimensions: DataFrame) -> DataFrame:
    """One row ``levels`` (comma-joined in column order) if two temporal dimensions or more exist."""
    found = dimensions.where("type = 'Temporal'").agg(F.array_sort(F.collect_list(F.struct("pos", "column"))).alias("levels"))
    return found.where(F.size("levels") >= 2).select(F.array_join(F.col("levels.column"), ",").alias("levels"))


def categorical_hierarchy(df: DataFrame) -> DataFrame:
    """``parent, child, mean_children`` of category columns where a parent has over 1.5 children on average."""
    columns = [c for c in df.columns if any(x in c.lower() for x in CATEGORY_NAMES)]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "parent string, child string, mean_children double")
    value = lambda c: tx.filled(F.col(f"`{c}`").cast("string"))
    rows = [F.struct(F.lit(a).alias("parent"), F.lit(b).alias("child"), value(a).alias("p"), value(b).alias("c")) for a, b in pairs]
    found = df.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("p is not null and c is not null")
    counts = found.groupBy("parent", "child", "p").agg(F.countDistinct("c").alias("n"))
    return counts.groupBy("parent", "child").agg(F.avg("n").alias("mean_children")).where("mean_children > 1.5")


def suggested_analyses(dimensions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``dimension, kind, measure`` rows for typed dimensions; one ``cross`` row for the first two."""
    measure = next((c for c in columns if any(x in c.lower() for x in MEASURE_NAMES)), None)
    with_measure = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit(measure).cast("string").alias("measure"))
    plain = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("measure"))
    more = lambda kind: [with_measure(kind)] if measure else []
    rows = (
        F.when(F.col("type") == "Temporal", F.array(plain("trend"), *more("sum_average")))
        .when(F.col("type") == "Identifier", F.array(plain("per_entity"), plain("frequency")))
        .when(F.col("type") == "Categorical", F.array(plain("compare"), *more("average")))
        .when(F.col("type") == "Geographic", F.array(plain("regional")))
    )
    out = dimensions.select(F.col("column").alias("dimension"), F.explode(rows).alias("x")).select("dimension", "x.kind", "x.measure")
    two = dimensions.orderBy("pos").limit(2).agg(F.array_sort(F.collect_list(F.struct("pos", "column"))).alias("d"), F.count("*").alias("n")).where("n = 2")
    return out.unionByName(two.select(F.array_join(F.col("d.column"), " x ").alias("dimension"), F.lit("cross").alias("kind"), F.lit(None).cast("string").alias("measure")))


def group_keys(column: Column, delimiter: str | None = None, vocabulary: list[str] | None = None) -> Column:
    """The keys of a row for a grouped sink: distinct, lower case; several for packed cells, none for blank ones."""
    if delimiter is not None:
        parts = F.transform(F.split(tx.text(column), "\\Q" + delimiter + "\\E"), lambda x: F.lower(tx.clean_cell(x)))
    elif vocabulary is not None:
        clean = F.lower(tx.clean_cell(column))
        parts = F.coalesce(tx.segment(clean, vocabulary), F.array(clean))
    else:
        parts = F.array(F.lower(tx.clean_cell(column)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def group_summary(df: DataFrame, keys: Column) -> DataFrame:
    """``group_key, file_name, rows`` of a grouped sink."""
    found = df.select(F.explode(keys).alias("group_key")).groupBy("group_key").agg(F.count("*").alias("rows"))
    return named_groups(found).select("group_key", "file_name", "rows")
