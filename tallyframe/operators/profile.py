"""Column profiles: counts, top values, content patterns, sequences, status columns, cardinality relations.

Blank cells count as null. Columns are turned into (column, value) rows once and aggregated together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import text as tx

#: Name parts of status columns.
STATUS_NAMES = ("status", "state", "stage", "phase")


def cells(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``pos, column, value`` rows of the chosen columns, blank as null, besides the ``keep`` columns."""
    chosen = list(columns or df.columns)
    pairs = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), tx.filled(F.col(f"`{c}`").cast("string")).alias("value")) for i, c in enumerate(chosen)]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("__cell")).select(*keep, "__cell.pos", "__cell.column", "__cell.value")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``pos, column, value, n``; nulls are a value of their own."""
    return cells(df, columns).groupBy("pos", "column", "value").agg(F.count("*").alias("n"))


def _totals() -> list[Column]:
    return [
        F.sum("n").alias("total_values"), F.count("value").alias("unique_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
    ]


def _of_all_columns(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts by ``pos`` as a row for each column of the frame, zeros where it has no row."""
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "pos int, column_name string")
    out = names.join(counts.drop("column"), "pos", "left").na.fill(0)
    return out.withColumn("distinct_ratio", F.when(F.col("total_values") > 0, F.col("unique_values") / F.col("total_values")).otherwise(0.0))


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """``pos, column_name, total_values, unique_values, null_count, distinct_ratio`` (of all values).

    Exact counts shuffle each distinct cell; ``approx`` counts distinct values with a sketch and shuffles none.
    """
    if approx:
        counts = cells(df).groupBy("pos").agg(
            F.count("*").alias("total_values"), F.approx_count_distinct("value").alias("unique_values"), F.count_if(F.col("value").isNull()).alias("null_count")
        )
    else:
        counts = value_counts(df).groupBy("pos", "column").agg(*_totals())
    return _of_all_columns(df, counts)


def top_values(df: DataFrame, k: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, value, n, place``: the k most frequent filled values; ties to the smaller value."""
    order = Window.partitionBy("pos").orderBy(F.desc("n"), "value")
    return value_counts(df, columns).where("value is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("pos")


def _with_keys(df: DataFrame, order_by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    keys = [f"__o{i}" for i in range(len(order_by))]
    return df.select(*[F.col(f"`{c}`") for c in df.columns], *(F.col(f"`{c}`").alias(k) for c, k in zip(order_by, keys))), keys


def head_cells(df: DataFrame, order_by: Sequence[str], n: int | None, condition=None, columns: Sequence[str] | None = None) -> DataFrame:
    """``pos, column, place, value``: the first n filled cells of each column that meet the condition; None: all of them, without places."""
    placed, keys = _with_keys(df, order_by)
    found = cells(placed, columns or df.columns, keys).where("value is not null")
    found = found.where(condition) if condition is not None else found
    if n is None:
        return found.select("pos", "column", F.lit(None).cast("int").alias("place"), "value")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("pos").orderBy(*keys))).where(F.col("place") <= n).select("pos", "column", "place", "value")


def _kinds(close: Column) -> list[Column]:
    """What filled cells are: all numbers, all booleans, an email or an address among the close ones."""
    v = F.col("value")
    return [
        F.every(tx.is_numeric_text(v)).alias("numeric"), F.every(tx.is_boolean_text(v)).alias("boolean"),
        F.some(close & tx.looks_like_email(v)).alias("email"), F.some(close & tx.looks_like_url(v)).alias("url"),
    ]


def counted(frames: dict[str, DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """A row a column of each ``table``: its counts, what its cells are, and of whole-number cells how many, how many distinct, least and largest.

    The cells of all tables are counted together, in two shuffles.
    """
    held = None
    for name, df in frames.items():
        part = cells(df, columns).select(F.lit(name).alias("table"), "pos", "column", "value")
        held = part if held is None else held.unionByName(part)
    whole = tx.is_integer_text(F.col("value"))
    counts = held.groupBy("table", "pos", "column", "value").agg(F.count("*").alias("n")).withColumn("v", F.when(whole, F.col("value").try_cast("long")))
    some = F.col("v").isNotNull()
    numbers = [F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("ints"), F.count_if(some).alias("distinct_ints"), F.min("v").alias("least"), F.max("v").alias("largest")]
    # What holds for all cells holds for all distinct values, so whole columns need no scan of their own.
    return counts.groupBy("table", "pos", "column").agg(*_totals(), *_kinds(F.lit(True)), *numbers).withColumn("filled", F.col("total_values") - F.col("null_count"))


def _may_step(r: Row) -> bool:
    """Whether the counts allow that whole-number cells go up one by one: as many values as cells, without a gap."""
    return r.ints > 0 and r.ints == r.distinct_ints and r.largest - r.least + 1 == r.ints


def _stepwise(df: DataFrame, order_by: Sequence[str], asked: Sequence[str]) -> set[str]:
    """Those of some columns that may step that do. A column that is the order itself does; the others are sorted by it."""
    whole_types = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    known = {c for c in asked if c == order_by[0] and c in whole_types}
    rest = [c for c in asked if c not in known]
    return known | {r.column for r in _sorted_steps(df, order_by, rest).where("stepwise").collect()} if rest else known


def sequences(df: DataFrame, order_by: Sequence[str], head: int | None = 100, columns: Sequence[str] | None = None) -> DataFrame:
    """``pos, column, n, stepwise``: of the first whole-number cells, how many, and whether each is one more than the last.

    ``head`` None looks at all cells: they are counted at once, and only columns whose counts leave it open are sorted.
    """
    if head is not None:
        whole = tx.is_integer_text(F.col("value"))
        found = head_cells(df, order_by, head, whole, columns).withColumn("v", F.col("value").cast("long"))
        found = found.withColumn("last", F.lag("v").over(Window.partitionBy("pos").orderBy("place")))
        return found.groupBy("pos", "column").agg(F.count("*").alias("n"), F.every(F.col("last").isNull() | (F.col("v") == F.col("last") + 1)).alias("stepwise"))
    facts = [r for r in sorted(counted({"": df}, columns).collect(), key=lambda r: r.pos) if r.ints]
    steps = _stepwise(df, order_by, [r.column for r in facts if _may_step(r)])
    return df.sparkSession.createDataFrame([(r.pos, r.column, r.ints, r.column in steps) for r in facts], "pos int, column string, n long, stepwise boolean")


def _sorted_steps(df: DataFrame, order_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``pos, column, n, stepwise`` by the order of all cells: each range of it by itself, then where the ranges meet."""
    whole = tx.is_integer_text(F.col("value"))
    chosen = df.select(*dict.fromkeys([*(f"`{c}`" for c in columns), *(f"`{c}`" for c in order_by)]))
    placed, keys = _with_keys(chosen, order_by)
    ranged = placed.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    found = cells(ranged, columns, ["__part", *keys]).where("value is not null").where(whole).withColumn("v", F.col("value").cast("long"))
    found = found.withColumn("last", F.lag("v").over(Window.partitionBy("__part", "pos").orderBy(*keys)))
    place = F.struct(*keys)
    parts = found.groupBy("__part", "pos", "column").agg(
        F.count("*").alias("n"), F.every(F.col("last").isNull() | (F.col("v") == F.col("last") + 1)).alias("ok"),
        F.min_by("v", place).alias("first"), F.max_by("v", place).alias("end"),
    )
    parts = parts.withColumn("before", F.lag("end").over(Window.partitionBy("pos").orderBy("__part")))  # a row a range and column
    return parts.groupBy("pos", "column").agg(F.sum("n").alias("n"), F.every(F.col("ok") & (F.col("before").isNull() | (F.col("first") == F.col("before") + 1))).alias("stepwise"))


def auto_increment(df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None, head: int | None = 100) -> DataFrame:
    """Columns whose first whole-number cells (``head`` None: all), over three of them, go up one by one."""
    return sequences(df, order_by, head, columns).where("stepwise and n > 3").select("column")


def _with_steps(rows: Sequence[Row], df: DataFrame, order_by: Sequence[str], matters: Callable[[Row], bool]) -> list[tuple]:
    """Counted columns with ``stepwise``, which is looked for only where it ``matters`` and the counts allow it."""
    steps = _stepwise(df, order_by, [r.column for r in rows if _may_step(r) and matters(r)])
    return [(*r, r.column in steps) for r in rows]


def _settled_facts(frames: dict[str, DataFrame], order_by: dict[str, Sequence[str]], matters: Callable[[Row], bool]) -> DataFrame:
    """``table`` and the facts of all whole columns of some frames, counted in one job. The driver gets a row a column."""
    out = counted(frames)
    by_table: dict[str, list[Row]] = {}
    for r in sorted(out.collect(), key=lambda r: r.pos):
        by_table.setdefault(r.table, []).append(r)
    rows = [x for name, found in by_table.items() for x in _with_steps(found, frames[name], order_by[name], matters)]
    return out.sparkSession.createDataFrame(rows, T.StructType([*out.schema.fields, T.StructField("stepwise", T.BooleanType())]))


def column_facts(df: DataFrame, order_by: Sequence[str], head: int | None = 100, near: int | None = 20, matters: Callable[[Row], bool] = lambda r: True) -> DataFrame:
    """A row a column with filled or blank cells: its counts, what its first cells are, and whether they are a sequence."""
    if head is None:
        return _settled_facts({"": df}, {"": order_by}, matters).drop("table")
    counts = value_counts(df).groupBy("pos", "column").agg(*_totals())
    close = F.lit(True) if near is None else F.col("place") <= near
    counts = counts.join(head_cells(df, order_by, head).groupBy("pos").agg(*_kinds(close)), "pos", "left")
    steps = sequences(df, order_by, head).select("pos", F.col("n").alias("ints"), "stepwise")
    return counts.join(steps, "pos", "left").withColumn("filled", F.col("total_values") - F.col("null_count"))


def _sequential() -> Column:
    return F.coalesce(F.col("numeric") & (F.col("filled") > 3) & F.col("stepwise") & (F.col("ints") > 0), F.lit(False))


def _unique() -> Column:
    return _sequential() | F.coalesce((F.try_divide("unique_values", "filled") > 0.95) & (F.col("filled") > 10), F.lit(False))


def _shown_by_steps(r: Row) -> bool:
    """Whether a column is Sequential if its cells step."""
    return bool(r.numeric) and r.filled > 3


def _key_by_steps(r: Row) -> bool:
    """Whether a column is a key only if its cells step: few cells, or between 0.9 and 0.95 of them distinct."""
    return _shown_by_steps(r) and r.unique_values > 0.9 * r.total_values and not (r.filled > 10 and r.unique_values / r.filled > 0.95)


def column_patterns(df: DataFrame, order_by: Sequence[str], head: int | None = 100, near: int | None = 20) -> DataFrame:
    """``column, pattern``: Numeric, Boolean, Email, Url, Sequential, UniqueIdentifier, Category.

    By the first ``head`` filled cells of a column (Email and Url: ``near``) in the order of ``order_by``; ``head`` None: by all.
    """
    found = column_facts(df, order_by, head, near, _shown_by_steps).where("filled > 0")
    share = F.try_divide("unique_values", "filled")
    flags = {
        "Numeric": F.col("numeric"), "Boolean": F.col("boolean"), "Email": F.col("email"), "Url": F.col("url"), "Sequential": _sequential(),
        "UniqueIdentifier": _unique(), "Category": (share < 0.1) & (F.col("unique_values") > 1) & (F.col("unique_values") < 50),
    }
    names = F.array_compact(F.array(*(F.when(c, n) for n, c in flags.items())))
    return found.select("column", F.explode(names).alias("pattern"))


def column_keys(df: DataFrame, order_by: Sequence[str], head: int | None = 100) -> DataFrame:
    """``profile_columns`` with ``is_key``: the UniqueIdentifier pattern and a distinct ratio over 0.9."""
    facts = column_facts(df, order_by, head, matters=_key_by_steps).withColumn("is_key", _unique()).select("pos", "column", "total_values", "unique_values", "null_count", "is_key")
    return _of_all_columns(df, facts).withColumn("is_key", F.coalesce("is_key", F.lit(False)) & (F.col("distinct_ratio") > 0.9))


def keys_of_all(frames: dict[str, DataFrame], order_by: dict[str, Sequence[str]]) -> DataFrame:
    """``table`` and ``column_keys`` of the whole columns of many frames, counted in one job."""
    spark = next(iter(frames.values())).sparkSession
    facts = _settled_facts(frames, order_by, _key_by_steps).withColumn("is_key", _unique()).drop("column")
    names = spark.createDataFrame([(t, i, c) for t, df in frames.items() for i, c in enumerate(df.columns)], "table string, pos int, column_name string")
    found = names.join(facts, ["table", "pos"], "left").na.fill(0, ["total_values", "unique_values", "null_count"])
    ratio = F.when(F.col("total_values") > 0, F.col("unique_values") / F.col("total_values")).otherwise(0.0)
    return found.select("table", "pos", "column_name", "total_values", "unique_values", "null_count", (F.coalesce("is_key", F.lit(False)) & (ratio > 0.9)).alias("is_key"), ratio.alias("distinct_ratio"))


def status_flows(df: DataFrame, order_by: Sequence[str], head: int | None = None) -> DataFrame:
    """``column, state`` of columns named like a status with 2 to 19 states, in the first ``head`` rows or all; a blank cell is a state."""
    columns = [c for c in df.columns if any(x in c.lower() for x in STATUS_NAMES)]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, state string")
    rows = df.orderBy(*order_by).limit(head) if head is not None else df
    states = cells(rows, columns).select("column", F.coalesce("value", F.lit("")).alias("state")).distinct()
    known = states.groupBy("column").agg(F.count("*").alias("n")).where("n > 1 and n < 20")
    return states.join(F.broadcast(known.select("column")), "column")  # a row a column


def _relation(n_a: int, n_b: int, many_a: int, many_b: int) -> tuple[str, float] | None:
    """What two columns are to each other: of the values of each that meet the other, how many there are and how many meet several."""
    if not many_a and not many_b and n_a > 5:
        return "OneToOne", 1.0
    if many_a > 0.5 * n_a and n_b > n_a:
        return "OneToMany", many_a / n_a
    if many_b > 0.5 * n_b and n_a > n_b:
        return "ManyToOne", many_b / n_b
    return None


def _settled(a: Row, b: Row) -> tuple[int, int, int, int] | None:
    """The counts of ``_relation`` where those of the single columns, without blanks, give them; else None."""
    if a.null_count or b.null_count or not any(x.unique_values == x.total_values or x.unique_values == 1 for x in (a, b)):
        return None
    # A unique column pairs with each row once; a constant one with every value of the other.
    if a.unique_values == a.total_values:
        many_a, many_b = 0, b.repeated
    elif b.unique_values == b.total_values:
        many_a, many_b = a.repeated, 0
    elif a.unique_values == 1:
        many_a, many_b = int(b.unique_values > 1), 0
    else:
        many_a, many_b = 0, int(a.unique_values > 1)
    return a.unique_values, b.unique_values, many_a, many_b


def _classes(df: DataFrame, names: Sequence[str], partners: Sequence[str]) -> dict[tuple[str, str], tuple[int, int]]:
    """Of each column's values, how many meet filled cells of each partner, and how many meet several different ones.

    Rows are grouped once by each column's values, all columns in one shuffle. A class of rows holds the least and the largest hash of
    each partner's cells; where they differ, the value meets several. Cells of a class are told apart by 64-bit hashes.
    """
    held = df.select(*(tx.filled(F.col(f"`{c}`").cast("string")).alias(f"v{i}") for i, c in enumerate(names)))
    hashes = [F.when(F.col(f"v{names.index(c)}").isNotNull(), F.xxhash64(f"v{names.index(c)}")).alias(f"h{j}") for j, c in enumerate(partners)]
    own = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v")) for i in range(len(names))))).alias("x")
    rows = held.select(*hashes, own).select("x.*", *(f"h{j}" for j in range(len(partners)))).where("v is not null")
    ends = rows.groupBy("i", "v").agg(*(f(f"h{j}").alias(f"{name}{j}") for j in range(len(partners)) for name, f in (("low", F.min), ("high", F.max))))
    sums = [x for j in range(len(partners)) for x in (F.count(f"low{j}").alias(f"n{j}"), F.count_if(F.col(f"low{j}") < F.col(f"high{j}")).alias(f"m{j}"))]
    return {(names[r.i], c): (r[f"n{j}"], r[f"m{j}"]) for r in ends.groupBy("i").agg(*sums).collect() for j, c in enumerate(partners)}


def column_relations(df: DataFrame, columns: Sequence[str] | None = None, most_partners: int = 50) -> DataFrame:
    """``column_a, column_b, type, strength`` of column pairs: OneToOne, OneToMany, ManyToOne.

    The columns are counted first, which settles pairs with a unique or constant column. For the others each row is grouped by each
    column once, however many pairs there are (once more for each ``most_partners`` columns). The driver gets two numbers a pair.
    """
    chosen = list(columns or df.columns)
    repeated = F.count_if(F.col("value").isNotNull() & (F.col("n") > 1)).alias("repeated")
    facts = {r.pos: r for r in value_counts(df, chosen).groupBy("pos").agg(*_totals(), repeated).collect()} if len(chosen) > 1 else {}
    counts = {(i, j): _settled(facts[i], facts[j]) for i in sorted(facts) for j in sorted(facts) if i < j}
    left = [pair for pair, found in counts.items() if found is None]
    names = [chosen[i] for i in sorted({i for pair in left for i in pair})]
    met: dict[tuple[str, str], tuple[int, int]] = {}
    for start in range(0, len(names), most_partners):
        met |= _classes(df, names, names[start : start + most_partners])
    for i, j in left:
        (n_a, many_a), (n_b, many_b) = (met.get((chosen[x], chosen[y]), (0, 0)) for x, y in ((i, j), (j, i)))
        counts[i, j] = n_a, n_b, many_a, many_b
    found = [(chosen[i], chosen[j], *r) for (i, j), n in counts.items() if (r := _relation(*n))]
    return df.sparkSession.createDataFrame(found, "column_a string, column_b string, type string, strength double")


def primary_key_candidates(df: DataFrame, order_by: Sequence[str], head: int | None = 100) -> DataFrame:
    """Columns with the UniqueIdentifier pattern and a distinct ratio over 0.9."""
    return column_keys(df, order_by, head).where("is_key").select("column_name", "distinct_ratio")
