"""Hard-negative mining by coordinate pruning in buckets of like length.

Rows are dealt into ranges by label, then from long to short vectors, and a range is cut into buckets of ``BUCKET`` rows
of like length. A bucket holds, for each coordinate, its rows in the order of that coordinate of their unit vectors. A
query that looks for scores of ``t`` or more needs a cosine of at least ``t / (its length * the bucket's longest)``:
above 1, the bucket is skipped. Otherwise each of the query's ``FOCUS`` focus coordinates, its largest ones, has a
feasible range: with a the angle whose cosine is the query's coordinate and d that of the needed cosine, a row's
coordinate lies between ``cos(a + d)`` and ``cos(a - d)``. The ranges are looked up in the sorted lists, the sets of rows that
they hold are intersected, and what is left is verified by exact inner products. Where no range is shorter than
``WORTH`` of the bucket, the whole bucket is verified.

An anchor first meets the rows of its label, its own range before the others, for its positives. Their scores give
windows of negative scores; in a second meeting the anchor goes to all ranges that hold another label and are long enough, and
keeps the best rows of each window. A task holds a tile of anchors (``TILE`` at most) with the best rows so far, and a range's
rows pass it as a stream. Rows of a hot label are spread over many ranges.

Scores are exact integers; ties go to the smaller ``vec_id``. Rows with a null id or label, a null vector, or a null or
non-finite component take no part; a shorter vector counts as padded with zeros. An anchor id that repeats is asked
once, with its smallest vector and label; other repeated rows count each, but rows with the anchor's id never do.
Positives below zero have no window and give no row; at zero only scores of zero fit. An anchor without positives, and an
empty table, give no row; other columns of the frame are not looked at. Scores beyond 64 bits are clipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm._common import cut
from tallyframe.llm.search import _matrix, quantised, scores

#: Rows of a bucket; most rows of a range; least rows for the sake of which a range is split between idle cores; most
#: anchors of a tile, about; anchors that meet a bucket at once.
BUCKET, GROUP, LEAST, TILE, CHUNK = 1024, 1 << 22, 1 << 11, 1 << 16, 512
#: Coordinates of a query that are looked up, and the share of a bucket below which their ranges are intersected.
FOCUS, WORTH = 6, 0.7
#: What is allowed for the rounding of cosines, so that no row at a threshold is lost.
SLACK = 1e-9
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def lengths(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))


def feasible(coordinate: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between what values a unit vector's coordinate lies if its cosine with a unit vector that has ``coordinate`` there is ``cosine`` or more."""
    angle, most = np.arccos(np.clip(coordinate, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(np.minimum(np.pi, angle + most)) - SLACK, np.cos(np.maximum(0, angle - most)) + SLACK


class Bucket:
    """Rows of like length, with a list of them for each coordinate, ordered by that coordinate of their unit vectors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray):
        self.ids, self.labels, self.matrix = ids, labels, matrix
        size = lengths(matrix)
        self.longest = float(size.max(initial=0))
        unit = matrix / np.maximum(size, 1e-300)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable")
        values = np.take_along_axis(unit, self.order, axis=0)
        # All lists end to end, each raised by 4 times its coordinate, so that one search looks up any of them.
        self.flat = (values + 4.0 * np.arange(values.shape[1])).T.ravel()

    def found(self, queries: np.ndarray, sizes: np.ndarray, focus: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, int]:
        """The scores of the rows that may reach ``least`` for each query, ``LOWEST`` elsewhere; and how many were verified."""
        n, width = self.matrix.shape
        out = np.full((len(queries), n), LOWEST, dtype=np.int64)
        whole = sizes * self.longest
        cosine = np.where((least > 0) & (whole > 0), least / np.maximum(whole, 1e-300), -1.0)
        alive = np.flatnonzero((cosine <= 1 + SLACK) & ~((least > 0) & (whole <= 0)))
        if not len(alive):
            return out, 0
        f = focus[alive]
        low, high = feasible(np.take_along_axis(queries[alive], f, axis=1) / np.maximum(sizes[alive], 1e-300)[:, None], cosine[alive][:, None])
        first = np.searchsorted(self.flat, low + 4.0 * f) - f * n
        last = np.searchsorted(self.flat, high + 4.0 * f, side="right") - f * n
        first, last = np.clip(first, 0, n), np.clip(last, 0, n)
        pruned = (last - first).min(axis=1) < WORTH * n
        pruned &= cosine[alive] > -1
        full = alive[~pruned]
        if len(full):
            out[full] = scores(queries[full], self.matrix)
        seen = len(full) * n
        for i in np.flatnonzero(pruned):
            lists = [self.order[a:b, c] for a, b, c in zip(first[i], last[i], f[i]) if b - a < n]
            rows = np.flatnonzero(np.bincount(np.concatenate(lists), minlength=n) == len(lists))
            if len(rows):
                out[alive[i], rows] = scores(queries[alive[i]][None, :], self.matrix[rows])[0]
                seen += len(rows)
        return out, seen


class Meeting:
    """A tile of anchors with windows of scores, and the best ``k`` rows of each window so far."""

    def __init__(self, asks: pa.Table, kind: str, k: int, same: bool):
        self.ids, self.labels = asks["vec_id"].to_numpy(), np.array(asks["label"].to_pylist(), dtype=object)
        self.matrix, self.kind, self.k, self.same = _matrix(asks["v"], kind), kind, k, same
        windows = [asks[c].to_pylist() for c in ("low", "high")]
        most = max(map(len, windows[0]), default=0)
        self.low, self.high = (np.array([w + [none] * (most - len(w)) for w in side], dtype=np.int64).reshape(len(self.ids), most) for side, none in zip(windows, (HIGHEST, LOWEST)))
        self.kth = self.low.copy()
        self.best = tuple(np.empty(0, dtype=np.int64) for _ in range(3))  # window, vec_id, score
        self.verified = self.met = 0
        self._known(self.matrix.shape[1])

    def _known(self, width: int) -> None:
        self.matrix = np.pad(self.matrix, ((0, 0), (0, max(0, width - self.matrix.shape[1]))))
        self.sizes = lengths(self.matrix)
        self.focus = np.argsort(-np.abs(self.matrix), axis=1, kind="stable")[:, :FOCUS]

    def meet(self, rows: pa.RecordBatch) -> None:
        if not len(self.ids) or not self.low.shape[1] or not rows.num_rows:
            return
        matrix = _matrix(rows.column("v"), self.kind)
        if matrix.shape[1] > self.matrix.shape[1]:
            self._known(matrix.shape[1])
        matrix = np.pad(matrix, ((0, 0), (0, self.matrix.shape[1] - matrix.shape[1])))
        ids, labels = rows.column("vec_id").to_numpy(), np.array(rows.column("label").to_pylist(), dtype=object)
        for start in range(0, len(ids), BUCKET):
            part = slice(start, start + BUCKET)
            bucket = Bucket(ids[part], labels[part], matrix[part])
            for first in range(0, len(self.ids), CHUNK):
                self._met(bucket, np.arange(first, min(first + CHUNK, len(self.ids))))

    def _met(self, bucket: Bucket, q: np.ndarray) -> None:
        found, seen = bucket.found(self.matrix[q], self.sizes[q], self.focus[q], self.kth[q].min(axis=1).astype(np.float64))
        self.verified, self.met = self.verified + seen, self.met + found.size
        least = np.maximum(self.kth[q].min(axis=1), LOWEST + 1)
        at, row = np.nonzero((found >= least[:, None]) & (found <= self.high[q].max(axis=1)[:, None]))
        fits = ((self.labels[q[at]] == bucket.labels[row]) == self.same) & (self.ids[q[at]] != bucket.ids[row])
        at, row = at[fits], row[fits]
        score, windows, fresh = found[at, row], self.low.shape[1], [self.best]
        for w in range(windows):
            # A row at the k-th score may still have a smaller id.
            inside = (score >= self.kth[q[at], w]) & (score <= self.high[q[at], w])
            fresh.append((q[at[inside]] * windows + w, bucket.ids[row[inside]], score[inside]))
        if not sum(len(x[0]) for x in fresh[1:]):
            return
        best = tuple(np.concatenate(x) for x in zip(*fresh))
        order = np.lexsort((best[1], -best[2], best[0]))
        best = tuple(x[order] for x in best)
        place = np.arange(len(order)) - np.searchsorted(best[0], best[0])
        full = place == self.k - 1
        self.kth.reshape(-1)[best[0][full]] = np.maximum(self.kth.reshape(-1)[best[0][full]], best[2][full])
        self.best = tuple(x[place < self.k] for x in best)

    def rows(self) -> pa.RecordBatch:
        windows = max(1, self.low.shape[1])
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[self.best[0] // windows]), pa.array((self.best[0] % windows).astype(np.int32)), *map(pa.array, self.best[1:])],
            names=["query_id", "window", "vec_id", "score"],
        )


def _meetings(batches: Iterator[pa.RecordBatch], kind: str, k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """The best rows of each (range, tile), of batches that hold its anchors (``is_row`` 0) before its rows."""
    key, asks, meeting = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("part", "tile", "is_row")]) if batch.num_rows else np.empty((3, 0), dtype=np.int64)
        cuts = np.flatnonzero(np.r_[True, (np.diff(keys, axis=1) != 0).any(axis=0)]) if batch.num_rows else []
        for start, stop in zip(cuts, [*cuts[1:], batch.num_rows]):
            part, tile, is_row = keys[:, start].tolist()
            if (part, tile) != key:
                if meeting is not None:
                    yield meeting.rows()
                key, asks, meeting = (part, tile), [], None
            piece = batch.slice(start, stop - start)
            if not is_row:
                asks.append(piece)
                continue
            if meeting is None and asks:
                meeting, asks = Meeting(pa.Table.from_batches(asks), kind, k, same), []
            if meeting is not None:
                meeting.meet(piece)
    if meeting is not None:
        yield meeting.rows()


def mine(
    df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its best ``positives`` other rows of its label; for each, its best ``negatives`` rows of other labels
    that score ``low`` to ``high`` hundredths of the positive's score are given.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"), label.cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asked")
    ).where("vec_id is not null and v is not null and label is not null")
    n, largest = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, F.abs(x))))).first()
    kind = "<i2" if (largest or 0) < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"

    def measure(batches):
        for batch in batches:
            lists = batch.column("v")
            flat, counts = lists.flatten().to_numpy(zero_copy_only=False).astype(kind), lists.value_lengths().to_numpy(zero_copy_only=False)
            packed = pa.array([x.tobytes() for x in np.split(flat, np.cumsum(counts)[:-1])] if len(counts) else [], type=pa.binary())
            size = lengths(_matrix(packed, kind)) if len(counts) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed, batch.column("label"), batch.column("asked"), pa.array(size)], names=["vec_id", "v", "label", "asked", "size"])

    groups = max(-(-n // GROUP), min(spark.sparkContext.defaultParallelism, -(-n // LEAST)), 1)
    sized = rows.mapInArrow(measure, "vec_id long, v binary, label string, asked boolean, size double").withColumn("row", F.monotonically_increasing_id())
    ranged = sized.repartitionByRange(groups, F.col("label"), F.desc("size"), F.col("vec_id"), F.col("row"))
    pieces = cut(ranged.select(F.spark_partition_id().alias("part"), "vec_id", "v", "label", "asked", "size"))
    # However many partitions Spark made of it, ``groups`` ranges of neighbouring ones.
    made = (pieces.agg(F.max("part")).first()[0] or 0) + 1
    pieces = pieces.withColumn("part", F.floor(F.col("part") * min(groups, made) / made).cast("int"))
    # A row a range, and a range is LEAST rows or more where there are more than a few.
    ranges = pieces.groupBy("part").agg(F.min("label"), F.max("label"), F.max("size")).orderBy("part").collect()
    parts, first, last, longest = (np.array([r[i] for r in ranges], dtype=t) for i, t in enumerate((np.int32, object, object, np.float64)))

    asked = cut(pieces.where("asked").groupBy("vec_id").agg(F.min(F.struct("v", "label", "size", "part")).alias("q")).select("vec_id", "q.*"))
    tiles = max(1, -(-asked.count() // TILE))

    def routed(asks: DataFrame, choose) -> DataFrame:
        """The asks, each sent to the ranges that ``choose(label, own part)`` allows and that are long enough for its lowest score."""

        def run(batches):
            for batch in batches:
                at, to = [], []
                for i, (own, name, size, low_) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "label", "size", "low")))):
                    able = choose(name, own)
                    least = min(low_, default=HIGHEST)
                    if least > 0:
                        able = able & (size * longest >= least * (1 - SLACK))
                    to.append(parts[able])
                    at.append(np.full(len(to[-1]), i))
                chosen = batch.select(["vec_id", "v", "label", "low", "high"]).take(pa.array(np.concatenate(at) if at else [], type=pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to) if to else [], type=pa.int32()), *chosen.columns], names=["part", *chosen.schema.names])

        return asks.select("vec_id", "v", "label", "part", "size", "low", "high").mapInArrow(run, "part int, vec_id long, v binary, label string, low array<long>, high array<long>")

    def met(sent: DataFrame, k: int, same: bool) -> DataFrame:
        """``query_id, window, vec_id, score``: the best of each window in each range that an ask was sent to."""
        tile = F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).alias("tile")
        none = F.lit(None).cast("array<long>")
        asks = sent.select("part", tile, F.lit(0).alias("is_row"), F.lit(0.0).alias("size"), "vec_id", "v", "label", "low", "high")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile")
        held = pieces.select("part", every, F.lit(1).alias("is_row"), "size", "vec_id", "v", "label", none.alias("low"), none.alias("high"))
        both = asks.unionByName(held).repartition(min(groups, made) * tiles, "part", "tile").sortWithinPartitions("part", "tile", "is_row", F.desc("size"))
        return both.mapInArrow(lambda batches: _meetings(batches, kind, k, same), "query_id long, window int, vec_id long, score long")

    def best(found: DataFrame, k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "window").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    own_label = lambda name: (first <= name) & (last >= name)
    open_ = asked.withColumn("low", F.array(F.lit(LOWEST).cast("long"))).withColumn("high", F.array(F.lit(HIGHEST).cast("long")))
    pilot = cut(best(met(routed(open_, lambda name, own: parts == own), positives, True), positives))
    bound = pilot.where(F.col("rank") == positives).select(F.col("query_id").alias("vec_id"), F.array("score").alias("bound"))
    bounded = open_.join(bound, "vec_id", "left").withColumn("low", F.coalesce("bound", "low"))
    more = met(routed(bounded, lambda name, own: own_label(name) & (parts != own)), positives, True)
    # Positives with one score have one window; scores below zero have none.
    near = best(pilot.drop("rank").unionByName(more), positives).where("score >= 0")
    near = cut(near.select(F.col("query_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    order = Window.partitionBy("anchor_id").orderBy("positive_score")
    near = near.withColumn("window", F.dense_rank().over(order) - 1)

    windows = near.groupBy("anchor_id").agg(F.array_sort(F.collect_set("positive_score")).alias("s"))  # ``positives`` at most
    whole = lambda f: F.transform("s", lambda s: f(s.cast("decimal(28,0)")).cast("long"))
    windows = windows.select(F.col("anchor_id").alias("vec_id"), whole(lambda s: F.ceil(s * low / F.lit(100))).alias("low"), whole(lambda s: F.floor(s * high / F.lit(100))).alias("high"))
    asks = asked.join(windows, "vec_id")
    found = best(met(routed(asks, lambda name, own: (first != name) | (last != name)), negatives, False), negatives)
    out = near.join(found.select(F.col("query_id").alias("anchor_id"), "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
