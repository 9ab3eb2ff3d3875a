"""Packed cells: delimiters, vocabularies, repeated patterns, long outliers, and splitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import text as tx
from tallyframe.operators import profile, segmentation
from tallyframe.sources import files

#: Delimiters in the order that decides ties.
DELIMITERS = (",", ";", "|", "\t", "\n")
#: Words of a shard of a vocabulary, about: what a task of a segmentation holds.
MOST_WORDS = 100_000


def _cells(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return profile.cells(df, columns).where("value is not null")


def detect_delimiter(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, delimiter, share``: in over 20 % of five filled cells or more, of which 80 % at most look like dates."""
    v = F.col("value")
    shares = [F.avg(v.contains(d).cast("double")).alias(f"s{i}") for i, d in enumerate(DELIMITERS)]
    found = _cells(df, columns).groupBy("column").agg(F.count("*").alias("n"), F.avg(tx.looks_like_date(v).cast("double")).alias("dates"), *shares)
    best = F.greatest(*(F.col(f"s{i}") for i in range(len(DELIMITERS))))
    which = None
    for i, d in enumerate(DELIMITERS):
        which = F.when(F.col(f"s{i}") == best, d) if which is None else which.when(F.col(f"s{i}") == best, d)
    return found.where("n >= 5 and dates <= 0.8").select("column", which.alias("delimiter"), best.alias("share")).where("share > 0.2")


def split_cell(value: Column, delimiter: Column | str) -> Column:
    """Trimmed parts of a cell, blanks dropped."""
    sign = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    parts = F.split(value, F.concat(F.lit("\\Q"), sign, F.lit("\\E")))
    return F.filter(F.transform(parts, tx.trim_ws), lambda x: x != "")


def vocabulary(df: DataFrame, column: str, delimiter: str) -> DataFrame:
    """Distinct trimmed parts of three bytes or more."""
    atoms = df.select(F.explode(split_cell(tx.text(F.col(f"`{column}`")), delimiter)).alias("atom"))
    return atoms.where(F.octet_length("atom") >= 3).distinct()


def global_vocabulary(frames: dict[str, DataFrame]) -> DataFrame:
    """The union of the vocabularies of all delimited columns of all sources."""
    out = None
    for df in frames.values():
        found = detect_delimiter(df)
        cells = _cells(df, None).join(F.broadcast(found), "column")  # a row a column
        atoms = cells.select(F.explode(split_cell(F.col("value"), F.col("delimiter"))).alias("atom")).where(F.octet_length("atom") >= 3)
        out = atoms if out is None else out.unionByName(atoms)
    return out.distinct()


def delimited_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, method, delimiter, confidence, total_count, multi_value_count, ratio, atoms`` of delimited columns."""
    found = detect_delimiter(df, columns)
    cells = _cells(df, columns).join(F.broadcast(found), "column")  # a row a column
    raw = F.split("value", F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E")))
    parts = split_cell(F.col("value"), F.col("delimiter"))
    numeric = F.size(F.filter(parts, lambda x: tx.is_numeric_text(F.regexp_replace(x, ",", ""))))
    stats = cells.groupBy("column", "delimiter", "share").agg(
        F.count("*").alias("total_count"), F.count_if(F.col("value").contains(F.col("delimiter"))).alias("multi_value_count"),
        F.avg(F.size(raw)).alias("parts"), (F.sum(numeric) / F.sum(F.size(parts))).alias("numeric"),
    )
    confidence = F.col("share") * F.when(F.abs(F.col("parts") - 2) < 0.5, 0.5).otherwise(1.0) * F.when(F.col("numeric") > 0.5, 0.1).otherwise(1.0)
    atoms = cells.select("column", F.explode(parts).alias("atom")).distinct().groupBy("column").agg(F.count("*").alias("atoms"))
    return stats.join(atoms, "column", "left").select(
        "column", F.lit("Delimited").alias("method"), "delimiter", confidence.alias("confidence"), "total_count", "multi_value_count",
        (F.col("multi_value_count") / F.col("total_count")).alias("ratio"), F.coalesce("atoms", F.lit(0)).alias("atoms"),
    )


def report_atoms(df: DataFrame, column: str, delimiter: str, k: int = 50) -> DataFrame:
    """The k smallest distinct atoms of a delimited column."""
    return df.select(F.explode(split_cell(tx.text(F.col(f"`{column}`")), delimiter)).alias("atom")).distinct().orderBy("atom").limit(k)


def _finding(method: str, confidence: Column) -> list[Column]:
    return [
        "column", F.lit(method).alias("method"), F.lit(None).cast("string").alias("delimiter"), confidence.alias("confidence"), "total_count",
        "multi_value_count", F.col("ratio"), F.lit(0).cast("long").alias("atoms"),
    ]


def segments(values: DataFrame, words: DataFrame) -> DataFrame:
    """``value, parts``: the word break of every distinct ``value`` by a vocabulary of any size (``atom``); no row where no cover exists."""
    return segmentation.segments(values, words, MOST_WORDS)


def segmented_reports(frames: dict[str, DataFrame], words: list[str] | DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``table`` and the columns of which 10 % of cells (500 bytes at most) are two vocabulary words or more written together.

    ``words``: a list, or a frame with the column ``atom``, which never reaches the driver. The cells of all tables are segmented together.
    """
    spark, cells = next(iter(frames.values())).sparkSession, None
    for name, df in frames.items():
        part = _cells(df, columns).groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("table", F.lit(name))
        cells = part if cells is None else cells.unionByName(part)
    if isinstance(words, list):
        words = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "atom string")
    if words.distinct().limit(5).count() < 5:
        cells, parts = cells.where("false"), spark.createDataFrame([], "value string, parts array<string>")
    else:
        parts = segments(cells.where(F.octet_length("value") <= 500), words).where(F.size("parts") >= 2)
    cells = cells.join(parts.select("value", F.lit(True).alias("packed")), "value", "left")
    found = cells.groupBy("table", "column").agg(F.sum("n").alias("total_count"), F.coalesce(F.sum(F.when(F.col("packed"), F.col("n"))), F.lit(0)).cast("long").alias("multi_value_count"))
    found = found.withColumn("ratio", F.col("multi_value_count") / F.col("total_count")).where("ratio >= 0.1")
    return found.select("table", *_finding("VocabularySegmented", F.least(1.5 * F.col("ratio"), F.lit(0.95))))


def vocabulary_segmented_report(df: DataFrame, words: list[str] | DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``segmented_reports`` of one table."""
    return segmented_reports({"": df}, words, columns).drop("table")


def pattern_repetition_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns of which over 10 % of cells repeat the most frequent shape twice or more."""
    counts = _cells(df, columns).groupBy("column", tx.shape(F.col("value")).alias("shape")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("column").orderBy(F.desc("n"), "shape")
    modal = counts.withColumn("place", F.row_number().over(order)).where("place = 1").select("column", F.col("shape").alias("modal")).where(F.octet_length("modal") >= 3)
    # What holds for a cell holds for its shape, so shapes are compared once each.
    found = counts.join(F.broadcast(modal), "column")  # a row a column
    packed = (F.octet_length("shape") >= 2 * F.octet_length("modal")) & (tx.count_non_overlapping(F.col("shape"), F.col("modal")) >= 2)
    found = found.groupBy("column").agg(F.sum("n").alias("total_count"), F.sum(F.when(packed, F.col("n")).otherwise(0)).cast("long").alias("multi_value_count"))
    found = found.withColumn("ratio", F.col("multi_value_count") / F.col("total_count")).where("ratio > 0.1")
    return found.select(*_finding("PatternRepetition", 0.6 * F.col("ratio")))


def length_outlier_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with two cells or more far longer than the median, by the modified z-score over 3.5."""
    # Cells of a length are counted once; all else weighs lengths by their counts.
    counts = _cells(df, columns).groupBy("column", F.octet_length("value").alias("bytes")).agg(F.count("*").alias("n"))
    middle = counts.groupBy("column").agg(F.percentile("bytes", F.lit(0.5), F.col("n")).alias("median"))
    far = counts.join(F.broadcast(middle), "column")  # a row a column
    spread = far.groupBy("column").agg(F.percentile(F.abs(F.col("bytes") - F.col("median")), F.lit(0.5), F.col("n")).alias("mad"))
    z = 0.6745 * F.abs(F.col("bytes") - F.col("median")) / F.col("mad")
    outlying = F.when((z > 3.5) & (F.col("bytes") > F.col("median")), F.col("n")).otherwise(0)
    found = far.join(F.broadcast(spread.where("mad > 0")), "column").groupBy("column").agg(F.sum("n").alias("total_count"), F.sum(outlying).cast("long").alias("multi_value_count"))
    found = found.withColumn("ratio", F.col("multi_value_count") / F.col("total_count")).where("multi_value_count >= 2")
    return found.select(*_finding("LengthOutlier", 0.4 * F.col("ratio")))


def detect_multi_value(frames: dict[str, DataFrame], words: list[str] | DataFrame | None = None) -> DataFrame:
    """``table`` and one finding a column: delimiter, else vocabulary, else pattern, else outlier.

    A column whose delimiter finding is under 0.2 has none of the later ones either. ``words`` defaults to the shared vocabulary of
    all sources, which is written once and read by whatever needs it.
    """
    if words is None:
        shared = global_vocabulary(frames)
        path = files.shared_path(shared.sparkSession, "vocabulary")
        shared.write.parquet(path)
        words = shared.sparkSession.read.parquet(path)
    out = segmented_reports(frames, words).withColumn("priority", F.lit(1))
    for name, df in frames.items():
        for i, r in ((0, delimited_report(df)), (2, pattern_repetition_report(df)), (3, length_outlier_report(df))):
            out = out.unionByName(r.withColumn("priority", F.lit(i)).withColumn("table", F.lit(name)))
    first = Window.partitionBy("table", "column").orderBy("priority")
    found = out.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place", "priority")
    return found.where((F.col("method") != "Delimited") | (F.col("confidence") >= 0.2))


def split_values(df: DataFrame, column: str, delimiter: str | None = None, words: list[str] | None = None, name: str = "atom") -> DataFrame:
    """One row per atom of a packed column, all other columns kept."""
    value = F.col(f"`{column}`")
    parts = split_cell(tx.text(value), delimiter) if delimiter is not None else F.coalesce(tx.segment(tx.trim_(value), words or []), F.array(tx.trim_(value)))
    return df.withColumn(name, F.explode(parts))
