"""Delimited, flat and fixed-width text; row numbers; mapped imports; pages; schema catalogues; grouped sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import text as tx


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, which driver and executors share; where it is unset (tests), in a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    shared = shared or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, with_row_no: bool = False) -> DataFrame:
    """Quoted text, every column a string; ragged rows are an error; without a header ``column_i``.

    ``with_row_no`` adds ``row_no``, the 0-based place of a row in the files, by path.
    """
    df = spark.read.csv(path, sep=delimiter, header=header, quote='"', escape='"', mode="FAILFAST", inferSchema=False, enforceSchema=False)
    names = df.columns if header else [f"column_{i + 1}" for i in range(len(df.columns))]
    if not with_row_no:
        return df.toDF(*names)
    return _numbered_in_files(df).toDF(*names, "row_no")


def _numbered_in_files(df: DataFrame) -> DataFrame:
    """The rows of files with their 0-based place, by path, without moving them.

    A first scan counts the rows of each split and notes the id that Spark gives its first row; the second takes a row's place in
    its split from its own id. Should the splits be dealt to partitions in another way then, the query fails.
    """
    found = ["file_path", "file_block_start", "file_block_length"]
    split = [F.col(f"_metadata.{c}").alias(f"__{c}") for c in found]
    placed = df.select("*", *split, F.monotonically_increasing_id().alias("__id"))
    keys = [f"__{c}" for c in found]
    counts = placed.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = Window.orderBy("__file_path", "__file_block_start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    bases = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    at = F.col("__id") - F.col("__first")
    place = F.when(at.between(0, F.col("__n") - 1), F.col("__base") + at).otherwise(F.raise_error(F.lit("the splits changed between two scans")).cast("long"))
    return placed.join(F.broadcast(bases), keys, "left").select(*df.columns, place.alias("row_no"))


def read_flat_delimited(spark: SparkSession, path: str, separator: str, names: Sequence[str]) -> DataFrame:
    """Text split at every separator, without quoting; fields trimmed, missing ones empty."""
    parts = F.split("value", "\\Q" + separator + "\\E")
    return spark.read.text(path).select(*(tx.trim_(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)))


def read_fixed_width(spark: SparkSession, path: str, widths: Sequence[int], names: Sequence[str]) -> DataFrame:
    starts = [1 + sum(widths[:i]) for i in range(len(widths))]
    return spark.read.text(path).select(*(tx.trim_(F.substring("value", s, w)).alias(n) for s, w, n in zip(starts, widths, names)))


def jdbc_table(spark: SparkSession, url: str, table: str, properties: dict[str, str]) -> DataFrame:
    return spark.read.jdbc(url, table, properties=properties)


def information_schema_columns(columns: DataFrame, constraints: DataFrame, key_usage: DataFrame) -> DataFrame:
    """The column catalogue with ``is_pk`` and ``is_fk``, one row a column, from ``information_schema`` frames."""
    keys = constraints.select("constraint_name", "constraint_type").join(key_usage.select("constraint_name", "table_name", "column_name"), "constraint_name")
    flags = keys.groupBy("table_name", "column_name").agg(
        F.max(F.col("constraint_type") == "PRIMARY KEY").alias("is_pk"), F.max(F.col("constraint_type") == "FOREIGN KEY").alias("is_fk")
    )
    found = columns.join(flags, ["table_name", "column_name"], "left")
    return found.select(
        "table_name", "column_name", "ordinal_position", logical_type(F.col("data_type"), F.col("max_length")).alias("type"), "nullable",
        F.coalesce("is_pk", F.lit(False)).alias("is_pk"), F.coalesce("is_fk", F.lit(False)).alias("is_fk"),
    )


def logical_type(name: Column, length: Column) -> Column:
    """The logical type of a SQL Server type name; national character types count two bytes a character."""
    # Type names of the catalogue and what they are called here.
    plain = {
        "int": "Integer", "bigint": "BigInt", "smallint": "SmallInt", "tinyint": "TinyInt", "bit": "Boolean", "float": "Float", "real": "Real",
        "decimal": "Decimal", "numeric": "Decimal", "money": "Decimal", "smallmoney": "Decimal", "date": "Date", "datetime": "DateTime",
        "datetime2": "DateTime2", "smalldatetime": "DateTime", "time": "Time", "timestamp": "Timestamp", "uniqueidentifier": "Uuid", "xml": "Xml",
        "text": "Text", "ntext": "Text", "binary": "Binary", "varbinary": "VarBinary", "image": "VarBinary",
    }
    out = F.when(name.isin("nvarchar", "nchar") & (length > 0), F.concat(F.when(name == "nchar", "Char(").otherwise("VarChar("), (length / 2).cast("int"), F.lit(")")))
    out = out.when(name.isin("varchar", "char") & (length > 0), F.concat(F.when(name == "char", "Char(").otherwise("VarChar("), length, F.lit(")")))
    out = out.when(name.isin("varchar", "nvarchar", "char", "nchar"), "Text")
    for k, v in plain.items():
        out = out.when(name == k, v)
    return out.otherwise("Unknown")


#: Bytes of a range of the order, about.
RANGE_BYTES = 128 << 20


def _ranges(df: DataFrame) -> int:
    """How many ranges to deal rows into: as many as shuffles have partitions, or more by the bytes of the plan's input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 60 else max(least, -(-size // RANGE_BYTES))  # a size that Spark doesn't know is the largest number


def running_totals(values: pa.Array, total: int) -> tuple[pa.Array, int]:
    """Running totals of decimals without digits after the point, from ``total`` on, and the last of them. Exact, by 32-bit limbs."""
    if not len(values):
        return values, total
    whole = (1 << 32) - 1
    limbs = np.frombuffer(values.buffers()[1], dtype="<u4")[4 * values.offset : 4 * (values.offset + len(values))].reshape(-1, 4).astype(np.int64)
    limbs[:, 3] -= (limbs[:, 3] >> 31) << 32  # the highest is signed
    sums = np.cumsum(limbs, axis=0) + np.array([total & whole, total >> 32 & whole, total >> 64 & whole, total >> 96], dtype=np.int64)
    for k in range(3):
        sums[:, k + 1] += sums[:, k] >> 32
    out = (sums & whole).astype("<u4").tobytes()
    return pa.Array.from_buffers(values.type, len(values), [None, pa.py_buffer(out)]), int.from_bytes(out[-16:], "little", signed=True)


def numbered(df: DataFrame, order_by: Sequence[str], name: str = "row_no") -> DataFrame:
    """Rows with their 0-based place in the order; rows that share a place are ordered by a hash of their cells."""
    # In a sorted range the low bits of the id that Spark gives a row are its place there.
    return _placed(df, order_by, F.lit(1), name, lambda rows: rows.withColumn("__local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("decimal(38,0)")), "long")


def prefix_sums(df: DataFrame, value: str, order_by: Sequence[str], name: str, before: bool = False, kind: str = "long") -> DataFrame:
    """Running totals of a whole-number column along an order, of type ``kind``; ``before`` leaves the row's own value out.

    Rows that share a place are ordered by a hash of their cells.
    """
    amount = F.coalesce(F.col(value).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))

    def local(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("__local", amount)

        def run(batches):
            total = 0
            for batch in batches:
                at = batch.schema.names.index("__local")
                sums, total = running_totals(batch.column(at), total)
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], sums, *batch.columns[at + 1 :]], names=batch.schema.names)

        added = rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]))
        return added.withColumn("__local", F.col("__local") - amount) if before else added

    return _placed(df, order_by, amount, name, local, kind)


def _placed(df: DataFrame, order_by: Sequence[str], amount: Column, name: str, local: Callable[[DataFrame], DataFrame], kind: str) -> DataFrame:
    """The rows with ``name``, what ``local`` gives of a sorted range and the amounts of all earlier ranges.

    Rows are moved once: those that are given and those whose amounts are added by range come from one exchange, which Spark uses
    twice, as both need all columns. Should it be made twice with other ranges, the first row of a range isn't the one that was
    counted, and the query fails.
    """
    ranged = df.repartitionByRange(_ranges(df), *order_by)
    part = F.spark_partition_id().alias("__part")
    cells = F.xxhash64(*(F.map_entries(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema.fields))
    start = F.struct(*(F.col(c).alias(f"s{i}") for i, c in enumerate(order_by)), cells.alias("row"))
    totals = ranged.select(part, start.alias("__start"), amount.alias("__amount")).groupBy("__part").agg(F.min("__start").alias("__start"), F.sum("__amount").cast("decimal(38,0)").alias("__amount"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = totals.select("__part", "__start", F.coalesce(F.sum("__amount").over(earlier), F.lit(0)).cast("decimal(38,0)").alias("__base"))
    placed = ranged.withColumn("__row", cells).sortWithinPartitions(*order_by, "__row").withColumn("__part", part).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    found = local(placed).join(F.broadcast(bases), "__part", "left")
    own = F.struct(*(F.col(c).alias(f"s{i}") for i, c in enumerate(order_by)), F.col("__row").alias("row"))
    wrong = (F.col("__at") == 0) & ~own.eqNullSafe(F.col("__start"))
    total = F.when(wrong, F.raise_error(F.lit("ranges were made twice")).cast(kind)).otherwise((F.col("__local") + F.col("__base")).cast(kind))
    return found.select(*(F.col(f"`{c}`") for c in df.columns), total.alias(name))


def import_mapped(df: DataFrame, mapping: dict[str, str], keep_unmapped: bool = True) -> DataFrame:
    """Columns renamed source to target. Unmapped or blank targets keep their name, or are dropped; blank headers and empty rows go."""
    chosen = []
    for c in df.columns:
        target = mapping.get(c, "")
        if c.strip() and (target.strip() or keep_unmapped):
            chosen.append(F.col(f"`{c}`").alias(target.strip() or c))
    out = df.select(*chosen)
    some = [tx.filled(F.col(f"`{c}`")).isNotNull() for c in out.columns]
    condition = some[0]
    for x in some[1:]:
        condition = condition | x
    return out.where(condition)


def match_columns(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """``column, field``: equal but for case, underscores, blanks and dashes; the first field by ``pos`` wins, else blank."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[_ \\-]", "")
    best = fields.groupBy(bare(F.col("field")).alias("__key")).agg(F.min_by("field", "pos").alias("field"))
    found = columns.withColumn("__key", bare(F.col("column"))).join(best, "__key", "left")
    return found.select("column", F.coalesce("field", F.lit("")).alias("field"))


def page(df: DataFrame, order_by: Sequence[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order_by).offset(offset).limit(limit)


def head_rows(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def sample_column(df: DataFrame, column: str, order_by: Sequence[str], n: int) -> DataFrame:
    """The first n rows' values of a column, then without the blank ones."""
    return df.orderBy(*order_by).limit(n).select(column).where(tx.trim_(F.col(column)) != "")


def schema_catalogue(frames: dict[str, DataFrame], mappings: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Per table: ``table, columns`` (sorted, comma-joined), ``row_count, mapping`` (original=mapped pairs)."""
    out = None
    for name, df in frames.items():
        pairs = ",".join(f"{a}={b}" for a, b in sorted((mappings or {}).get(name, {}).items()))
        row = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table"), F.lit(",".join(sorted(df.columns))).alias("columns"), "row_count", F.lit(pairs).alias("mapping")
        )
        out = row if out is None else out.unionByName(row)
    return out


def named_groups(groups: DataFrame, key: str = "group_key") -> DataFrame:
    """The groups with ``file_name``, their safe name; of several with one name, all but the first by key get a hash of the key after it."""
    name = tx.safe_name(F.col(key))
    place = F.row_number().over(Window.partitionBy(name).orderBy(key))
    longer = F.concat(F.substring(name, 1, 45), F.lit("~"), F.lower(F.hex(F.xxhash64(key))))  # 45 characters of four bytes at most
    return groups.withColumn("file_name", F.when(place == 1, name).otherwise(longer))


def write_grouped(df: DataFrame, keys: Column, path: str, format: str = "parquet", name: str = "group_key", most_bytes: int = 128 << 20) -> DataFrame:
    """One folder of files for each group, ``file_name=<safe name>``; ``keys`` is an array of a row's group keys, kept in the column ``name``.

    Groups are counted first; the counts, with the names of the folders, are written to ``_groups`` beside them and returned:
    ``name, rows, bytes, file_name, files``. A group of up to ``most_bytes``, by its cells as texts, is one file; a larger one is dealt by
    row to as many files as its bytes need, each written by one task and committed by Spark as a whole.
    """
    spark = df.sparkSession
    marked = df.withColumn("__id", F.monotonically_increasing_id()).withColumn(name, F.explode(keys))
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 1 for c in df.columns), F.lit(0))
    counts = marked.groupBy(name).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))
    counts = named_groups(counts, name).withColumn("files", F.ceil(F.col("bytes") / most_bytes).cast("int"))
    counts.write.parquet(f"{path}/_groups")
    groups = spark.read.parquet(f"{path}/_groups")
    total, rows, bytes_, alike = groups.agg(F.sum("files"), F.sum("rows"), F.sum("bytes"), F.count("*") - F.countDistinct("file_name")).first()
    if alike:
        raise ValueError(f"{alike} groups share the name of another")
    tasks = min(total or 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(bytes_ or 0) // most_bytes)))
    # Files that one task gets of a group are one file, which a count of rows splits again.
    most_rows = max(1, most_bytes * (rows or 1) // max(1, bytes_ or 1))
    placed = marked.join(groups.select(name, "file_name", "files"), name).withColumn("__file", F.pmod(F.xxhash64("__id"), F.col("files")))
    placed = placed.repartition(tasks, "file_name", "__file").select(*(F.col(f"`{c}`") for c in df.columns), name, "file_name")
    placed.write.option("maxRecordsPerFile", most_rows).partitionBy("file_name").format(format).mode("append").save(path)
    return groups
