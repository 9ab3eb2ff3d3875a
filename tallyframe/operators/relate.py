"""Relationship and workflow detection over catalogues, and the joined master record.

``tables(table, row_count, source_type, pos)`` and ``columns(table, pos, column, unique_count, is_pk, is_fk)`` are
catalogues: a row a table or column, small beside the data. ``relationships`` has ``from_table, from_column,
to_table, to_column, kind, confidence``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import text as tx
from tallyframe.operators import profile

#: Name parts of staging, aggregate and lookup tables.
STAGING = ("stg_", "staging_", "temp_", "tmp_", "_stg", "_staging", "_temp")
AGGREGATES = ("_summary", "_agg", "_total", "_aggregate", "fact_", "sum_")
LOOKUPS = ("lookup_", "ref_", "dim_", "_ref", "_lookup")
#: Columns that a word of a set of columns has bits for.
BITS = 62
#: Column suffixes and the column of the other table that they point at.
SUFFIXES = (("id", "id"), ("_id", "id"), ("key", "key"), ("_key", "key"), ("_pk", "id"))


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "_", "")


def _first_table(asked: DataFrame, tables: DataFrame, stem: str, own: str) -> DataFrame:
    """The first other table, by ``pos``, whose name without underscores equals or starts with the stem."""
    known = tables.select(F.col("table").alias("to_table"), F.col("pos").alias("__pos"), _bare(F.col("table")).alias("__name"))
    stem_ = _bare(F.col(stem))
    found = asked.where(stem_ != "").join(F.broadcast(known), F.col("__name").startswith(stem_) & (F.col(own) != F.col("to_table")))  # a catalogue
    first = Window.partitionBy(own, "column", stem).orderBy("__pos")
    return found.withColumn("__place", F.row_number().over(first)).where("__place = 1").drop("__place", "__name", "__pos")


def explicit_fk(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Foreign keys of database tables: ``XId`` to table X, column Id; ``XKey`` to X, Key."""
    keys = columns.where("is_fk").join(tables.where("source_type = 'mssql'").select("table"), "table").select("table", "column")
    name = F.lower("column")
    stems = F.when(name.endswith("id"), F.expr("left(column, length(column) - 2)")).when(name.endswith("key"), F.expr("left(column, length(column) - 3)"))
    found = _first_table(keys.withColumn("stem", stems).where("stem is not null"), tables, "stem", "table")
    return found.select(
        F.col("table").alias("from_table"), F.col("column").alias("from_column"), "to_table",
        F.when(F.lower("column").endswith("id"), "Id").otherwise("Key").alias("to_column"), F.lit("ForeignKey").alias("kind"), F.lit(95).alias("confidence"),
    )


def name_match(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Equal column names in several tables: key to foreign key 85, key and key 80, neither 60."""
    known = columns.drop("row_count").join(tables.select("table", "row_count", F.col("pos").alias("tpos")), "table")
    name = F.lower("column")
    known = known.withColumn("name", name).withColumn(
        "key", name.endswith("id") | F.col("is_pk") | ((F.col("unique_count") == F.col("row_count")) & (F.col("row_count") > 0))
    )
    stats = known.groupBy("name").agg(F.count_if("key").alias("keys"), F.count("*").alias("n"))
    known = known.join(stats.where("n > 1"), "name").select("name", "table", "column", "key", "tpos", "keys", "n")
    a, b = known.alias("a"), known.alias("b")
    pairs = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.table") != F.col("b.table")))
    mixed = (F.col("a.keys") > 0) & (F.col("a.keys") < F.col("a.n"))
    to_key = mixed & ~F.col("a.key") & F.col("b.key")
    plain = ~mixed & (F.col("a.tpos") < F.col("b.tpos"))
    confidence = F.when(mixed, 85).when(F.col("a.keys") > 0, 80).otherwise(60)
    return pairs.where(to_key | plain).select(
        F.col("a.table").alias("from_table"), F.col("a.column").alias("from_column"), F.col("b.table").alias("to_table"), F.col("b.column").alias("to_column"),
        F.lit("NameMatch").alias("kind"), confidence.alias("confidence"),
    )


def pattern_match(columns: DataFrame, tables: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Columns named after a table and its key, 70; those already known are left out."""
    options = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(s).alias("suffix"), F.lit(t).alias("target")) for i, (s, t) in enumerate(SUFFIXES)))
    asked = columns.select("table", "column", F.explode(options).alias("o")).select("table", "column", "o.*")
    asked = asked.where(F.lower("column").endswith(F.col("suffix")) & (F.length("column") > F.length("suffix")))
    asked = asked.withColumn("stem", F.expr("left(column, length(column) - length(suffix))"))
    found = _first_table(asked, tables, "stem", "table")
    targets = columns.select(F.col("table").alias("to_table"), F.col("column").alias("to_column"), F.col("pos").alias("cpos"))
    fits = (F.lower("to_column") == F.col("target")) | (F.lower("to_column") == F.lower(F.concat_ws("_", "stem", "target")))
    found = found.join(targets, "to_table").where(fits)
    first = Window.partitionBy("table", "column").orderBy("rank", "cpos")
    found = found.withColumn("place", F.row_number().over(first)).where("place = 1").select(
        F.col("table").alias("from_table"), F.col("column").alias("from_column"), "to_table", "to_column", F.lit("NameMatch").alias("kind"), F.lit(70).alias("confidence")
    )
    return found.join(known, ["from_table", "from_column", "to_table", "to_column"], "left_anti") if known is not None else found


def detect_relationships(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """All three detections; of equal candidates the most confident stays."""
    found = explicit_fk(columns, tables).unionByName(name_match(columns, tables))
    found = found.unionByName(pattern_match(columns, tables, found))
    best = Window.partitionBy("from_table", "from_column", "to_table", "to_column").orderBy(F.desc("confidence"))
    return found.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def score_relationships(relationships: DataFrame, frames: dict[str, DataFrame], pairs: Sequence[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """``confidence, overlap_count`` of candidate joins by their names and the values they share.

    ``pairs`` are the (from_table, from_column, to_table, to_column) to score; by default all candidates (a catalogue). Each table
    is read once for all its columns. Their distinct values make an inverted index, of a value to the set of columns that hold it, in
    one shuffle however many candidates there are; how many values each set has gives the overlaps of all pairs.
    """
    sides = ["from_table", "from_column", "to_table", "to_column"]
    spark = relationships.sparkSession
    # A row a candidate; found once, however often it is used.
    relationships = spark.createDataFrame(relationships.collect(), relationships.schema)
    asked = list(dict.fromkeys(tuple(r) for r in relationships.select(*sides).collect())) if pairs is None else list(dict.fromkeys(map(tuple, pairs)))
    numbers: dict[tuple[str, str], int] = {}
    for side in [x[:2] for x in asked] + [x[2:] for x in asked]:
        numbers.setdefault((side[0], side[1].lower()), len(numbers))
    # A column's bit: BITS columns a word. The cells of a value in a task are one set before the shuffle.
    words = range(max(1, -(-len(numbers) // BITS)))
    values = spark.createDataFrame([], ", ".join(["v string", *(f"w{w} long" for w in words)]))
    for name, df in frames.items():
        wanted = [c for c in df.columns if (name, c.lower()) in numbers]
        if wanted:
            at = [numbers[name, c.lower()] for c in wanted]
            bits = [F.element_at(F.array(*(F.lit(1 << n % BITS if n // BITS == w else 0).cast("long") for n in at)), F.col("pos") + 1).alias(f"w{w}") for w in words]
            values = values.unionByName(profile.cells(df, wanted).where("value is not null").select(F.col("value").alias("v"), *bits))
    index = values.groupBy("v").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in words))
    sets = index.groupBy(*(f"w{w}" for w in words)).agg(F.count("*").alias("n")).withColumn("w", F.array(*(f"w{w}" for w in words)))
    holds = lambda x: f"(w[cast({x} div {BITS} as int)] & shiftleft(1L, cast({x} % {BITS} as int))) != 0"
    members = sets.select("w", "n", F.explode(F.expr(f"filter(sequence(0, {max(0, len(numbers) - 1)}), x -> {holds('x')})")).alias("a"))
    sizes = members.groupBy("a").agg(F.sum("n").alias("size"))
    listed = spark.createDataFrame([(*x, numbers[x[0], x[1].lower()], numbers[x[2], x[3].lower()]) for x in asked], ", ".join(f"{c} string" for c in sides) + ", a int, b int")
    shared = members.join(listed.select("a", "b").distinct(), "a").where(F.expr(holds("b"))).groupBy("a", "b").agg(F.sum("n").alias("overlap_count"))
    out = listed.join(sizes.withColumnRenamed("size", "nl"), "a", "left").join(sizes.select(F.col("a").alias("b"), F.col("size").alias("nr")), "b", "left").join(shared, ["a", "b"], "left").drop("a", "b")
    scored = relationships.join(out, sides).na.fill(0, ["nl", "nr", "overlap_count"])
    ratio = F.col("overlap_count") / F.greatest(F.lit(1), F.least("nl", "nr"))
    total = F.least(F.floor(0.6 * F.col("confidence") + 40 * ratio + 1e-9), F.lit(100)).cast("int")
    return scored.select("from_table", "from_column", "to_table", "to_column", total.alias("confidence"), "overlap_count").orderBy(F.desc("confidence"), "from_table", "from_column", "to_table")


def relationships_for(relationships: DataFrame, table: str) -> DataFrame:
    return relationships.where((F.col("from_table") == table) | (F.col("to_table") == table))


def duplicate_imports(imports: DataFrame) -> DataFrame:
    """Table names that several imports other than the master record go by."""
    return imports.where("not is_master").groupBy("table").agg(F.count("*").alias("imports")).where("imports > 1").orderBy("table")


def master_record(frames: dict[str, DataFrame], primary: str, joins: Sequence[tuple[str, str, str]], order_by: dict[str, Sequence[str]], mapping: dict[str, str] | None = None) -> DataFrame:
    """The primary table with the columns of its lookups, by left joins on trimmed, lower-case keys.

    ``joins``: (column of the record so far, lookup table, its key), in order. Of the rows of a key the first by
    ``order_by``, then by its cells, counts, blank keys none; a clashing column is named ``<table>_<column>``. Last come the renames.
    """
    out = frames[primary]
    for column, table, key in joins:
        lookup = frames[table]
        names = {c: f"{table}_{c}" if c in out.columns else c for c in lookup.columns if c != key}
        place = F.struct(*order_by[table]) if order_by.get(table) else F.lit(1)
        first = lookup.select(tx.normalize_value(F.col(key)).alias("__key"), F.struct(*(F.col(c).alias(n) for c, n in names.items())).alias("__row"), place.alias("__place"))
        first = first.where("__key != ''").groupBy("__key").agg(F.min_by("__row", F.struct("__place", "__row")).alias("__row"))
        out = out.withColumn("__key", tx.normalize_value(F.col(column))).join(first, "__key", "left")
        out = out.select(*[c for c in out.columns if c not in ("__key", "__row")], *(F.col("__row")[n].alias(n) for n in names.values()))
    return out.withColumnsRenamed(mapping or {})


def primary_table(row_counts: dict[str, int]) -> str:
    """The table with most rows; the last one on a tie."""
    return max(enumerate(row_counts.items()), key=lambda x: (x[1][1], x[0]))[1][0]


def column_sets(columns: DataFrame) -> DataFrame:
    return columns.groupBy("table").agg(F.array_sort(F.collect_set(F.lower("column"))).alias("names"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def import_workflows(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """``source, destination, confidence``: file and database tables alike in name (0.3) and columns (0.7)."""
    sets = column_sets(columns)
    known = tables.join(sets, "table")
    files = known.where("source_type != 'mssql'").select(F.col("table").alias("source"), F.col("names").alias("a"))
    stored = known.where("source_type = 'mssql'").select(F.col("table").alias("destination"), F.col("names").alias("b"))
    # Two catalogues: a row a table.
    alike = 0.3 * tx.name_similarity(F.col("source"), F.col("destination")) + 0.7 * jaccard(F.col("a"), F.col("b"))
    found = files.join(F.broadcast(stored), alike > 0.5)
    return found.select("source", "destination", F.floor(100 * alike + 1e-9).cast("int").alias("confidence"))


def staging_workflows(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """``source, destination, confidence``: staging tables and the first other table that holds their bare name."""
    name = F.lower("table")
    marks = None
    for p in STAGING:
        m = name.startswith(p) | name.endswith(p)
        marks = m if marks is None else marks | m
    bare = name
    for p in STAGING:
        bare = F.replace(bare, F.lit(p), F.lit(""))
    sets = column_sets(columns)
    staged = tables.where(marks).select(F.col("table").alias("source"), bare.alias("bare")).where("bare != ''")
    known = tables.select(F.col("table").alias("destination"), "pos")
    found = staged.join(F.broadcast(known), F.lower("destination").contains(F.col("bare")) & (F.col("source") != F.col("destination")))  # a catalogue
    first = Window.partitionBy("source").orderBy(F.when(F.lower("destination") == F.col("bare"), 0).otherwise(1), "pos")
    found = found.withColumn("place", F.row_number().over(first)).where("place = 1")
    found = found.join(sets.withColumnRenamed("table", "source").withColumnRenamed("names", "a"), "source").join(sets.withColumnRenamed("table", "destination").withColumnRenamed("names", "b"), "destination")
    alike = jaccard(F.col("a"), F.col("b"))
    return found.where(alike > 0.5).select("source", "destination", F.floor(100 * alike + 1e-9).cast("int").alias("confidence"))


def aggregation_workflows(tables: DataFrame, relationships: DataFrame) -> DataFrame:
    """``destination, sources`` (sorted, comma-joined), 75: tables named like aggregates that others point at."""
    marks = F.lower("table").rlike("|".join(AGGREGATES))
    found = tables.where(marks).join(relationships, F.col("table") == F.col("to_table"))
    return found.groupBy(F.col("table").alias("destination")).agg(F.array_join(F.array_sort(F.collect_set("from_table")), ",").alias("sources")).withColumn("confidence", F.lit(75))


def lookup_tables(tables: DataFrame, relationships: DataFrame) -> DataFrame:
    """``table, incoming, confidence``: named like a lookup 90; under 1000 rows and over two incoming 70."""
    incoming = relationships.groupBy(F.col("to_table").alias("table")).agg(F.count("*").alias("incoming"))
    name, marks = F.lower("table"), None
    for p in LOOKUPS:
        m = name.startswith(p) | name.endswith(p)
        marks = m if marks is None else marks | m
    found = tables.join(incoming, "table", "left").na.fill(0, ["incoming"])
    confidence = F.when(marks, 90).when((F.col("row_count") < 1000) & (F.col("incoming") > 2), 70)
    return found.select("table", "incoming", confidence.alias("confidence")).where("confidence is not null")


def detect_workflows(tables: DataFrame, columns: DataFrame, relationships: DataFrame) -> DataFrame:
    """All workflows: ``type, steps`` array of (table, step_type), ``confidence``."""
    step = lambda c, kind: F.struct(F.col(c).alias("table"), F.lit(kind).alias("step_type"))
    two = lambda df, kind, first: df.select(F.lit(kind).alias("type"), F.array(step("source", first), step("destination", "destination")).alias("steps"), "confidence")
    agg = aggregation_workflows(tables, relationships)
    sources = F.transform(F.split("sources", ","), lambda t: F.struct(t.alias("table"), F.lit("source").alias("step_type")))
    return (
        two(import_workflows(tables, columns), "Import", "source")
        .unionByName(two(staging_workflows(tables, columns), "StagingToProduction", "staging"))
        .unionByName(agg.select(F.lit("Aggregation").alias("type"), F.concat(sources, F.array(step("destination", "destination"))).alias("steps"), "confidence"))
        .unionByName(lookup_tables(tables, relationships).select(F.lit("Lookup").alias("type"), F.array(step("table", "lookup")).alias("steps"), "confidence"))
    )

