"""Exact top-k inner product by block-at-a-time pruning.

Rows are dealt into ranges by a coarse code of the vector, then by id, and each range is cut into
blocks. A block has a forward index (its vectors as integers) and the largest and smallest weight of
every term (component). For a query, a block's bound is the sum of its term maxima: the query's weight
times the block's largest (or, for a negative weight, smallest) weight. Blocks are scored in the order
of their bounds, through their forward indexes, until the bounds fall below the k-th score so far.

A query first meets its own range and the first range of its code; its k-th row there, by score and id, is a
bound to start from. Then tiles of queries meet the other ranges, and the best ``k`` of all meetings
are merged; a row at the bound's score with a larger id isn't sent. A tile and a range are bounded numbers of
vectors, packed in the narrowest whole numbers that hold all components. Scores are exact integers; ties go
to the smaller ``vec_id``. Vectors that are null, or hold null or non-finite components, and rows with a null
id take no part; a shorter vector counts as padded with zeros. A query id that repeats is asked once, with
its smallest vector; repeated candidate rows count each, but a query's own id never does. An empty table gives
no row; other columns of the frame are not looked at. Scores beyond 64 bits are clipped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm._common import cut

#: Rows of a block; most rows of a range (what one task holds); least rows for the sake of which a range
#: is split between idle cores; most queries of a tile, about; queries that are scored at once.
BLOCK, GROUP, LEAST, TILE, CHUNK = 256, 1 << 16, 1 << 11, 1 << 16, 512
#: Components that make the coarse code, by the sign of their sums.
CODE_BITS = 12


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, x as double; null where a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _matrix(packed: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Packed vectors as rows of an int64 array, padded with zeros."""
    found = [np.frombuffer(x, dtype=kind) for x in packed.to_pylist()]
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    if out.size:
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(found)
    return out


def coarse_code(matrix: np.ndarray, bits: int = CODE_BITS) -> np.ndarray:
    """Signs of fixed pseudo-random sums of the components; close vectors tend to share a code."""
    signs = np.random.default_rng(7).choice([-1.0, 1.0], size=(matrix.shape[1], bits))
    return ((matrix @ signs > 0) @ (1 << np.arange(bits))).astype(np.int64)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products. In float64 while no sum can pass 2**53, else in whole numbers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[-1])
    if most < 2**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    exact = queries.astype(object) @ rows.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Blocks:
    """The forward indexes and term bounds of a group of blocks."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, size: int):
        self.ids, self.matrix, self.size = ids, matrix, size
        cuts = np.arange(0, len(ids), size)
        self.high = np.maximum.reduceat(matrix, cuts, axis=0)
        self.low = np.minimum.reduceat(matrix, cuts, axis=0)

    def widened(self, width: int) -> Blocks:
        """The same blocks with zeros up to a width."""
        missing = width - self.matrix.shape[1]
        return self if missing <= 0 else Blocks(self.ids, np.pad(self.matrix, ((0, 0), (0, missing))), self.size)

    def top(self, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None, least_id: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """The k best of the group for each query: place of the query, vec_id, score; none after ``least`` and ``least_id``, a known k-th row."""
        n = len(ids)
        bounds = scores(np.maximum(queries, 0), self.high) + scores(np.minimum(queries, 0), self.low)
        order = np.argsort(-bounds, axis=1, kind="stable")
        kth = np.full(n, np.iinfo(np.int64).min) if least is None else least.copy()
        best = tuple(np.empty(0, dtype=np.int64) for _ in range(3))  # place of the query, vec_id, score
        open_ = np.arange(n)
        for step in range(bounds.shape[1]):
            # A bound that equals the k-th score may still hold a smaller id.
            open_ = open_[bounds[open_, order[open_, step]] >= kth[open_]]
            if not len(open_):
                break
            block = order[open_, step]
            by_block = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(block[by_block]) != 0])
            fresh = [best]
            for part in np.split(by_block, starts[1:]):
                q, b = open_[part], block[part[0]]
                rows = slice(b * self.size, (b + 1) * self.size)
                found, names = scores(queries[q], self.matrix[rows]), self.ids[rows]
                # A query's own rows, however often they repeat, take none of the k places.
                found[names == ids[q][:, None]] = np.iinfo(np.int64).min
                least_here = np.partition(found, -k, axis=1)[:, -k] if len(names) > k else np.full(len(q), kth.min())
                at, row = np.nonzero(found >= np.maximum(least_here, kth[q])[:, None])
                other = names[row] != ids[q[at]]
                at, row = at[other], row[other]
                fresh.append((q[at], names[row], found[at, row]))
            best = tuple(np.concatenate(x) for x in zip(*fresh))
            sorted_ = np.lexsort((best[1], -best[2], best[0]))
            best = tuple(x[sorted_] for x in best)
            first = np.searchsorted(best[0], best[0])
            place = np.arange(len(first)) - first
            full = place == k - 1
            kth[best[0][full]] = np.maximum(kth[best[0][full]], best[2][full])
            best = tuple(x[place < k] for x in best)
        if least is not None and least_id is not None:
            near = (best[2] > least[best[0]]) | (best[1] <= least_id[best[0]])
            best = tuple(x[near] for x in best)
        return best


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """Per query its ``k`` best other rows: ``query_id, rank, vec_id, score``.

    ``is_query`` chooses the queries among the rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.where("vec_id is not null and v is not null")

    sizes = F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x)))
    n, largest = rows.agg(F.count("*"), F.max(sizes)).first()
    kind = "<i2" if (largest or 0) < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"

    def code(batches):
        for batch in batches:
            lists = batch.column("v")
            flat, counts = lists.flatten().to_numpy(zero_copy_only=False).astype(kind), lists.value_lengths().to_numpy(zero_copy_only=False)
            packed = pa.array([x.tobytes() for x in np.split(flat, np.cumsum(counts)[:-1])] if len(counts) else [], type=pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), packed, batch.column("asked"), pa.array(coarse_code(_matrix(packed, kind)) if len(counts) else [], type=pa.int64())],
                names=["vec_id", "v", "asked", "code"],
            )

    # Ranges of (code, id, row): ids are many, so a code that many rows share is spread over ranges.
    groups = max(-(-n // GROUP), min(spark.sparkContext.defaultParallelism, -(-n // LEAST)), 1)
    coded = rows.mapInArrow(code, "vec_id long, v binary, asked boolean, code long").withColumn("row", F.monotonically_increasing_id())
    ranged = coded.repartitionByRange(groups, "code", "vec_id", "row")
    pieces = cut(ranged.select(F.spark_partition_id().alias("part"), "code", "vec_id", "v", "asked"))
    # However many partitions Spark made of it, ``groups`` ranges of neighbouring ones.
    made = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    pieces = pieces.withColumn("part", F.floor(F.col("part") * min(groups, made) / made).cast("int"))

    asked = pieces.where("asked").groupBy("vec_id").agg(F.min(F.struct("v", "part", "code")).alias("q")).select("vec_id", "q.*")
    heads = pieces.groupBy("code").agg(F.min("part").alias("head"))  # a row a code
    asked = cut(asked.join(heads, "code").select("vec_id", "v", F.array_distinct(F.array("part", "head")).alias("pilots")))
    tiles = max(1, -(-asked.count() // TILE))
    asked = asked.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)))

    def meet(asks: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if held.num_rows and asks.num_rows:
            held = held.sort_by([("code", "ascending"), ("vec_id", "ascending")])
            matrix = _matrix(asks.column("v"), kind)
            blocks = Blocks(held.column("vec_id").to_numpy(), _matrix(held.column("v"), kind), BLOCK).widened(matrix.shape[1])
            matrix = np.pad(matrix, ((0, 0), (0, blocks.matrix.shape[1] - matrix.shape[1])))
            ids, least, least_id = (asks.column(c).to_numpy() for c in ("vec_id", "least", "least_id"))
            for start in range(0, len(ids), CHUNK):
                part = slice(start, start + CHUNK)
                at, vec, score = blocks.top(ids[part], matrix[part], k, least[part], least_id[part])
                out.append((ids[part][at], vec, score))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, dtype=np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))))

    def met(asks: DataFrame) -> DataFrame:
        """Queries, each sent to its ``parts``, against the rows of those: tiles of queries times ranges."""
        anew = lambda *names: [F.col(c).alias(c) for c in names]
        sent = asks.select(F.explode("parts").alias("part"), *anew("tile", "vec_id", "v", "least", "least_id"))
        held = pieces.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile"), *anew("part", "code", "vec_id", "v"))
        return sent.groupBy("part", "tile").cogroup(held.groupBy("part", "tile")).applyInArrow(meet, "query_id long, vec_id long, score long")

    lowest = F.lit(-(2**63)).cast("long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    pilot = cut(met(asked.select("*", F.col("pilots").alias("parts"), lowest.alias("least"), F.lit(2**63 - 1).alias("least_id"))).withColumn("rank", rank).where(F.col("rank") <= k))
    bound = pilot.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"), F.col("vec_id").alias("least_id"))
    others = F.array_except(F.sequence(F.lit(0), F.lit(min(groups, made) - 1)), "pilots")
    bounded = asked.join(bound, "vec_id", "left").select("tile", "vec_id", "v", F.coalesce("least", lowest).alias("least"), F.coalesce("least_id", F.lit(2**63 - 1)).alias("least_id"), others.alias("parts"))
    found = pilot.select("query_id", "vec_id", "score").unionByName(met(bounded))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
