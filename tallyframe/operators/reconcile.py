"""Two-source reconciliation: keys, matches, differing cells, column mapping, summaries.

Rows meet on a struct of normalised key parts (trimmed, lower case). The first row of a key, by
``order_by``, stands for it; later ones are duplicates. Blank keys are keys. What is compared are digests
of the rows; only rows whose digests differ are read in full. Of rows that the order doesn't tell apart,
the smallest cells or digest come first, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text as tx

def column_named(columns: Sequence[str], name: str) -> str | None:
    """The column equal to ``name``, else the first equal regardless of case."""
    return name if name in columns else next((c for c in columns if c.lower() == name.lower()), None)


def auto_key(columns1: Sequence[str], columns2: Sequence[str]) -> list[str]:
    """The first shared column that looks like a key, else the first shared column."""
    shared = [c for c in columns1 if column_named(columns2, c)]
    named = [c for c in shared if "id" in c.lower() or c.lower() == "key" or c.lower().endswith(" key")]
    if not shared:
        raise ValueError("the sources share no column")
    return (named or shared)[:1]


def recon_key(df: DataFrame, keys: Sequence[str]) -> Column:
    """The normalised key as a struct of parts."""
    found = [column_named(df.columns, k) for k in keys]
    if None in found:
        raise ValueError(f"a key column is missing: {keys} of {df.columns}")
    return F.struct(*(tx.normalize_value(df[c]).alias(f"k{i}") for i, c in enumerate(found)))


def key_text(key: Column | str, n: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat_ws("|", *(key[f"k{i}"] for i in range(n)))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows beyond the first of their key."""
    counts = df.groupBy(recon_key(df, keys).alias("key")).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def _place(order_by: Sequence[str]) -> list[Column]:
    return [F.struct(F.col(c).isNull().cast("int").alias("e"), F.col(c).alias("v")).alias(f"o{i}") for i, c in enumerate(order_by)]


def first_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], row: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``key``, ``row`` (a struct of the first row's ``columns``, all by default) and ``n`` rows of the key; combined before the shuffle.

    Of rows that ``order_by`` doesn't tell apart, the one with the smallest cells comes first.
    """
    keyed = df.select(recon_key(df, keys).alias("key"), F.struct(*(columns or df.columns)).alias("row"), *_place(order_by))
    place = F.struct(*(f"o{i}" for i in range(len(order_by))), "row")
    return keyed.groupBy("key").agg(F.min_by("row", place).alias(row), F.count("*").alias(f"n_{row}"))


def matched_rows(
    s1: DataFrame, s2: DataFrame, keys: Sequence[str], order_by: Sequence[str], order_by2: Sequence[str] | None = None, columns1: Sequence[str] | None = None, columns2: Sequence[str] | None = None,
) -> DataFrame:
    """``key, r1, n_r1, r2, n_r2`` of all keys in both sources, with whole rows or only some of their columns."""
    return first_rows(s1, keys, order_by, "r1", columns1).join(first_rows(s2, keys, order_by2 or order_by, "r2", columns2), "key")


#: First values of the two 64-bit halves of a digest.
HALVES = (3, 8)


def digest(cells: Sequence[Column]) -> list[Column]:
    """The 128-bit digest of some normalised cells, as two columns."""
    return [F.xxhash64(F.lit(h), *cells).alias(f"d{h}") for h in HALVES]


def _with_firsts(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows' ``key`` and ``first``, their place in the order with the digest of the compared cells, which decides between equal places."""
    return df.select("*", recon_key(df, keys).alias("__key"), F.struct(*_place(order_by), *digest([tx.normalize_value(F.col(c)) for c in columns])).alias("__first"))


def met_digests(
    s1: DataFrame, s2: DataFrame, keys: Sequence[str], order_by: Sequence[str], order_by2: Sequence[str], pairs: Sequence[tuple[str, str, str]]
) -> DataFrame:
    """All keys of two sources, ``key, f1, n1, f2, n2``: the place and digest of a key's first row, and its rows.

    Of the rows themselves, only keys, order and digests are shuffled.
    """
    sides = []
    for i, (df, order) in enumerate(((s1, order_by), (s2, order_by2)), 1):
        keyed = _with_firsts(df, keys, order, [p[i] for p in pairs])
        sides.append(keyed.groupBy(F.col("__key").alias("key")).agg(F.min("__first").alias(f"f{i}"), F.count("*").alias(f"n{i}")))
    return sides[0].join(sides[1], "key", "full_outer")


def _differ() -> Column:
    return (F.col("n1") > 0) & (F.col("n2") > 0) & (F.struct(*(F.col("f1")[f"d{h}"] for h in HALVES)) != F.struct(*(F.col("f2")[f"d{h}"] for h in HALVES)))


def differing_rows(
    s1: DataFrame, s2: DataFrame, keys: Sequence[str], order_by: Sequence[str], order_by2: Sequence[str] | None = None, compare: Sequence[str] | None = None,
    mappings: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """``key, r1, r2`` of the keys in both sources whose compared cells differ; ``r1`` and ``r2`` hold those cells alone, as texts.

    Digests find the keys; rows are read again for those alone, which a join on the keys fetches.
    """
    pairs = compared_columns(s1.columns, s2.columns, keys, compare, mappings)
    orders, rows, columns = (order_by, order_by if order_by2 is None else order_by2), None, [list(dict.fromkeys(p[i] for p in pairs)) for i in (1, 2)]
    half = f"d{HALVES[0]}"
    marks = [F.struct(F.xxhash64(*(F.col(f"f{i}")[f"o{k}"] for k in range(len(orders[i - 1]))), F.lit(0)), F.col(f"f{i}")[half]) for i in (1, 2)]
    asked = met_digests(s1, s2, keys, *orders, pairs).where(_differ()).select("key", F.array(*marks).alias("marks"))
    for i, (df, order) in enumerate(zip((s1, s2), orders), 1):
        texts = F.array(*(F.col(c).cast("string") for c in columns[i - 1])).cast("array<string>")
        part = df.select(recon_key(df, keys).alias("key"), F.lit(i).alias("side"), F.xxhash64(*_place(order), F.lit(0)).alias("place"), texts.alias("texts"))
        rows = part if rows is None else rows.unionByName(part)
    # Only rows that were asked for are digested again. Those with one key, place and digest differ in spelling only; the smallest spelling stands for them.
    own = [digest([tx.normalize_value(F.col("texts")[columns[i - 1].index(p[i])]) for p in pairs])[0] for i in (1, 2)]
    mark = F.struct(F.col("place"), F.when(F.col("side") == 1, own[0]).otherwise(own[1]))
    found = rows.join(asked, "key").where(mark == F.col("marks")[F.col("side") - 1])
    found = found.groupBy("key").agg(*(F.min(F.when(F.col("side") == i, F.col("texts"))).alias(f"t{i}") for i in (1, 2)))
    cells = lambda i: [F.col(f"t{i}")[at].alias(c) for at, c in enumerate(columns[i - 1])] or [F.lit("").alias("none")]
    return found.select("key", *(F.struct(*cells(i)).alias(f"r{i}") for i in (1, 2)))


def only_in(s1: DataFrame, s2: DataFrame, keys: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """Keys of one source only: ``source`` (1 or 2), ``key_value``. Reads the key columns alone, whatever the order."""
    counts = [df.groupBy(recon_key(df, keys).alias("key")).agg(F.count("*").alias(f"n{i}")) for i, df in enumerate((s1, s2), 1)]
    both = counts[0].join(counts[1], "key", "full_outer").where(F.col("n1").isNull() | F.col("n2").isNull())
    return both.select(F.when(F.col("n2").isNull(), 1).otherwise(2).alias("source"), key_text("key", len(keys)).alias("key_value"))


def compared_columns(
    columns1: Sequence[str], columns2: Sequence[str], keys: Sequence[str], compare: Sequence[str] | None = None, mappings: Sequence[tuple[str, str]] = ()
) -> list[tuple[str, str, str]]:
    """(label, column of source 1, column of source 2) of each comparison; key columns are equal already."""
    known = {k.lower() for k in keys}
    names = [c for c in (compare or columns1) if c.lower() not in known]
    pairs = [(c, column_named(columns1, c), column_named(columns2, c)) for c in names]
    return [p for p in pairs if p[1] and p[2]] + [(f"{a} vs {b}", a, b) for a, b in mappings]


def field_mismatches(
    matched: DataFrame, keys: Sequence[str], compare: Sequence[str] | None = None, mappings: Sequence[tuple[str, str]] = (), limit: int | None = 100
) -> DataFrame:
    """``key_value, column_name, source1_value, source2_value`` of differing cells, raw values, by key and column."""
    left, right = (matched.schema[r].dataType.names for r in ("r1", "r2"))
    cells = []
    for label, a, b in compared_columns(left, right, keys, compare, mappings):
        x, y = F.col("r1")[a], F.col("r2")[b]
        cell = F.struct(F.lit(label).alias("column_name"), x.cast("string").alias("source1_value"), y.cast("string").alias("source2_value"))
        cells.append(F.when(tx.normalize_value(x) != tx.normalize_value(y), cell))
    if not cells:
        return matched.select(key_text("key", len(keys)).alias("key_value"), *(F.lit("").alias(c) for c in ("column_name", "source1_value", "source2_value"))).where("false")
    out = matched.select(key_text("key", len(keys)).alias("key_value"), F.explode(F.array_compact(F.array(*cells))).alias("cell"))
    out = out.select("key_value", "cell.*")
    return out.orderBy("key_value", "column_name").limit(limit) if limit is not None else out


#: Pairs of a left and a right column of some rows that are looked at together.
MEETINGS = 1 << 22


def _equal_cells(left: np.ndarray, right: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """By pair of columns, rows with both cells filled and rows with equal ones; cells are numbered by their value.

    In each row the cells of both sides meet by their numbers, so only equal pairs are made.
    """
    n1, n2, rows = left.shape[1], right.shape[1], np.arange(len(left))[:, None]
    filled1, filled2 = left != blank, right != blank
    both = filled1.T.astype(np.float64) @ filled2.astype(np.float64)
    most = int(max(left.max(initial=0), right.max(initial=0))) + 1
    keys1, i = (rows * most + left)[filled1], np.nonzero(filled1)[1]
    keys2, j = (rows * most + right)[filled2], np.nonzero(filled2)[1]
    order = np.argsort(keys2, kind="stable")
    keys2, j = keys2[order], j[order]
    start = np.searchsorted(keys2, keys1)
    n = np.searchsorted(keys2, keys1, side="right") - start
    at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
    equal = np.bincount(np.repeat(i, n) * n2 + j[at], minlength=n1 * n2)
    return both.astype(np.int64).ravel(), equal.astype(np.int64)


def agreement(matched: DataFrame, columns1: Sequence[str], columns2: Sequence[str]) -> DataFrame:
    """``column1, column2, both, equal``: matched rows with both cells filled, and with equal ones.

    One pass over the matched rows counts all pairs of columns; a task gives a row a pair.
    """
    n1, n2 = len(columns1), len(columns2)
    cells = matched.select(*(F.array(*(tx.normalize_value(F.col(r)[c]) for c in columns)).alias(r) for r, columns in (("r1", columns1), ("r2", columns2))))

    def run(batches):
        both, equal = np.zeros(n1 * n2, dtype=np.int64), np.zeros(n1 * n2, dtype=np.int64)
        step = max(1, MEETINGS // (n1 * n2))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                left, right = (part.column(c).flatten() for c in ("r1", "r2"))
                coded = pa.concat_arrays([pa.array([""], type=left.type), left, right]).dictionary_encode().indices.to_numpy()
                split = 1 + part.num_rows * n1
                b, e = _equal_cells(coded[1:split].reshape(-1, n1), coded[split:].reshape(-1, n2), coded[0])
                both, equal = both + b, equal + e
        i, j = np.divmod(np.arange(n1 * n2), n2)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in ((i, np.int32), (j, np.int32), (both, np.int64), (equal, np.int64))], names=["i", "j", "both", "equal"])

    at = F.col("id").cast("int")
    none = matched.sparkSession.range(n1 * n2).select((at / n2).cast("int").alias("i"), (at % n2).alias("j"), F.lit(0).cast("long").alias("both"), F.lit(0).cast("long").alias("equal"))
    counts = cells.mapInArrow(run, "i int, j int, both long, equal long").unionByName(none).groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("equal").alias("equal"))
    name = lambda columns, at: F.element_at(F.array(*map(F.lit, columns)), F.col(at) + 1)
    return counts.select(name(columns1, "i").alias("column1"), name(columns2, "j").alias("column2"), "both", "equal")


def auto_column_mapping(matched: DataFrame, keys: Sequence[str], least: float = 0.5) -> list[tuple[str, str]]:
    """Pairs of unmatched columns whose cells agree in more than ``least`` of rows; greedy in source 1's order.

    The driver gets a number for each pair of unmatched columns.
    """
    left, right = (matched.schema[r].dataType.names for r in ("r1", "r2"))
    alone1 = [c for c in left if not column_named(right, c)]
    alone2 = [c for c in right if not column_named(left, c)]
    if not alone1 or not alone2:
        return []
    rates = {(r.column1, r.column2): r.equal / r.both for r in agreement(matched, alone1, alone2).collect() if r.both}
    out, used = [], set()
    for a in alone1:
        best = max((b for b in alone2 if b not in used), key=lambda b: (rates.get((a, b), 0.0), -alone2.index(b)), default=None)
        if best is not None and rates.get((a, best), 0.0) > least:
            out.append((a, best))
            used.add(best)
    return out


def reconcile(
    s1: DataFrame, s2: DataFrame, keys: Sequence[str] | None = None, order_by: Sequence[str] | None = None, name1: str = "source1",
    name2: str = "source2", compare: Sequence[str] | None = None, mappings: Sequence[tuple[str, str]] = (), order_by2: Sequence[str] | None = None,
) -> DataFrame:
    """The one-row summary of two sources.

    Without ``order_by`` the row with the smallest digest of its compared cells is a key's first. The sources are read twice: keys, order and
    digests of all rows first, then the compared cells of the keys that differ.
    """
    keys = list(keys or auto_key(s1.columns, s2.columns))
    order_by = list(order_by or [])
    order_by2 = list(order_by2 or [column_named(s2.columns, c) for c in order_by if column_named(s2.columns, c)])
    met = met_digests(s1, s2, keys, order_by, order_by2, compared_columns(s1.columns, s2.columns, keys, compare, mappings))
    in1, in2 = F.col("n1").isNotNull(), F.col("n2").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = met.agg(
        total("n1").alias("total_source1"), total("n2").alias("total_source2"), F.count_if(in1 & in2).alias("matches"), F.count_if(in1 & ~in2).alias("only_in_source1"),
        F.count_if(in2 & ~in1).alias("only_in_source2"), total(F.col("n1") - 1).alias("duplicates_source1"), total(F.col("n2") - 1).alias("duplicates_source2"),
        F.count_if(_differ()).alias("__differing"),
    )
    cells = field_mismatches(differing_rows(s1, s2, keys, order_by, order_by2, compare, mappings), keys, compare, mappings, limit=None)
    # One row each. The count of differing keys keeps the digests of both in one exchange.
    out = counts.where("__differing >= 0").drop("__differing").join(F.broadcast(cells.agg(F.count("*").alias("mismatches"))))
    distinct = F.greatest(F.col("matches") + F.col("only_in_source1"), F.col("matches") + F.col("only_in_source2"))
    share = F.when(distinct > 0, 100.0 * F.col("matches") / distinct).otherwise(0.0)
    return out.select(F.lit(name1).alias("source1"), F.lit(name2).alias("source2"), F.lit("|".join(keys)).alias("key_columns"), "*", share.alias("match_percentage"))


def reconcile_all(frames: dict[str, DataFrame]) -> DataFrame:
    """Summaries of all pairs of sources with default settings; sources that share no column give no row."""
    out = None
    for (n1, s1), (n2, s2) in combinations(frames.items(), 2):
        if not any(column_named(s2.columns, c) for c in s1.columns):
            continue
        row = reconcile(s1, s2, name1=n1, name2=n2)
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no two sources share a column")
    return out


def mismatches_all(frames: dict[str, DataFrame], order_by: Sequence[str] = ()) -> DataFrame:
    """``source1, source2, key_value, column_name, source1_value, source2_value`` of all pairs of sources that share a column."""
    out = None
    for (n1, s1), (n2, s2) in combinations(frames.items(), 2):
        if not any(column_named(s2.columns, c) for c in s1.columns):
            continue
        keys = auto_key(s1.columns, s2.columns)
        orders = [[column_named(df.columns, c) for c in order_by if column_named(df.columns, c)] for df in (s1, s2)]
        found = field_mismatches(differing_rows(s1, s2, keys, *orders), keys, limit=None).select(F.lit(n1).alias("source1"), F.lit(n2).alias("source2"), "*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no two sources share a column")
    return out
