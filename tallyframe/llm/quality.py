"""Quality classifier: a byte-level convolutional network in numpy.

Every byte of a text, padded to whole blocks, goes through learned filters of ``WIDTH`` bytes (a
table of 257 values a filter and place). Overlapping chunks of two blocks cover the whole text; each
filter is max-pooled over a chunk, a dense layer reads the chunk, and the text's score combines the
largest and the mean answer of its chunks into one probability.

The network is trained on the driver from whole texts of labelled rows: ``per_class`` rows a class at most,
in the order of a hash of their ids, and as many as ``most_bytes`` of text a class allow; those two bound
what the driver gathers. A labelled text past an eighth of ``most_bytes`` isn't chosen for training. Scoring
reads whole texts. A null or empty text is one block of padding and gets the score of that; without
training rows of both classes the score is the share of good labels (0.5 without labels). Repeated rows are
scored each; of labelled rows that repeat an id the smallest text trains, once. An empty table gives no row;
other columns of the frame are not looked at (``keep_good`` keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm._common import flat_utf8, id_and_text, keep_rows, slices

#: Bytes of a filter, filters, bytes of a block (a chunk is two), units of the dense layer.
WIDTH, FILTERS, BLOCK, HIDDEN = 6, 16, 128, 16
PAD = 256
#: Bounds of the training sample: rows and bytes of text a class. Passes and texts a step.
PER_CLASS, MOST_BYTES, EPOCHS, STEP = 1200, 16 << 20, 14, 48


def padded(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded to whole blocks with WIDTH - 1 pads at least, and the offsets of their blocks.

    A block's filters end in it, so all that they see before a text's first byte are pads, never another text.
    """
    sizes = np.diff(offsets)
    blocks = np.maximum(1, -(-(sizes + WIDTH - 1) // BLOCK))
    starts = np.r_[0, np.cumsum(blocks)]
    out = np.full(int(starts[-1]) * BLOCK + WIDTH, PAD, dtype=np.int16)
    out[np.repeat(starts[:-1] * BLOCK - offsets[:-1], sizes) + np.arange(WIDTH - 1, len(flat) + WIDTH - 1)] = flat
    return out, starts


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {
            "table": (r.normal(size=(WIDTH, 257, FILTERS)) * 0.4).astype(np.float32),
            "shift": np.zeros(FILTERS, dtype=np.float32),
            "dense": (r.normal(size=(FILTERS, HIDDEN)) * 0.35).astype(np.float32),
            "bias": np.zeros(HIDDEN, dtype=np.float32),
            "out": (r.normal(size=2 * HIDDEN) * 0.3).astype(np.float32),
            "last": np.zeros(1, dtype=np.float32),
        }
        self.prior = 0.0
        self.freeze()

    def best(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest value of each filter in each block, and where it lies."""
        n, step = (len(data) - WIDTH) // BLOCK, 128
        high, where = np.empty((n, FILTERS), dtype=np.float32), np.empty((n, FILTERS), dtype=np.int64)
        for start in range(0, n, step):
            size = min(step, n - start) * BLOCK
            total = self.p["table"][0].take(data[start * BLOCK : start * BLOCK + size], axis=0)
            for k in range(1, WIDTH):
                total += self.p["table"][k].take(data[start * BLOCK + k : start * BLOCK + k + size], axis=0)
            cube = total.reshape(-1, BLOCK, FILTERS)
            at = cube.argmax(axis=1)
            high[start : start + len(cube)] = np.take_along_axis(cube, at[:, None, :], 1)[:, 0]
            where[start : start + len(cube)] = at + (np.arange(start, start + len(cube)) * BLOCK)[:, None]
        return high, where

    def freeze(self) -> None:
        """Whole-number tables for scoring: sums of WIDTH values fit 16 bits, rounded by 1 in 30,000 of the largest sum."""
        self.scale = (30000 / np.maximum(1e-6, np.abs(self.p["table"]).max(axis=1).sum(axis=0))).astype(np.float32)
        self.whole = np.round(self.p["table"] * self.scale).astype(np.int16)

    def largest(self, data: np.ndarray) -> np.ndarray:
        """The largest value of each filter in each block, by the whole-number tables."""
        n, step = (len(data) - WIDTH) // BLOCK, 64
        high = np.empty((n, FILTERS), dtype=np.float32)
        total, more = (np.empty((step * BLOCK, FILTERS), dtype=np.int16) for _ in range(2))
        for start in range(0, n, step):
            size = min(step, n - start) * BLOCK
            codes = data[start * BLOCK : start * BLOCK + size + WIDTH].astype(np.intp)
            np.take(self.whole[0], codes[:size], axis=0, out=total[:size], mode="clip")
            for k in range(1, WIDTH):
                np.take(self.whole[k], codes[k : k + size], axis=0, out=more[:size], mode="clip")
                np.add(total[:size], more[:size], out=total[:size])
            cube, half = total[:size].reshape(-1, BLOCK, FILTERS), BLOCK
            while half > 1:
                half //= 2
                cube = np.maximum(cube[:, :half], cube[:, half : 2 * half])
            high[start : start + len(cube)] = cube[:, 0] / self.scale
        return high

    def forward(self, data: np.ndarray, starts: np.ndarray, train: bool = False):
        high, where = self.best(data) if train else (self.largest(data), None)
        count = np.diff(starts)
        chunks = np.maximum(1, count - 1)
        first = np.r_[0, np.cumsum(chunks)]
        left = np.repeat(starts[:-1] - first[:-1], chunks) + np.arange(first[-1])
        right = np.where(np.repeat(count == 1, chunks), left, left + 1)
        from_left = high[left] >= high[right]
        pooled = np.where(from_left, high[left], high[right]) + self.p["shift"]
        active = np.tanh(pooled * 0.5)
        hidden = np.tanh(active @ self.p["dense"] + self.p["bias"])
        top = np.maximum.reduceat(hidden, first[:-1], axis=0)
        mean = np.add.reduceat(hidden, first[:-1], axis=0) / chunks[:, None]
        both = np.concatenate([top, mean], axis=1)
        logit = both @ self.p["out"] + self.p["last"][0]
        return logit, (where, chunks, first, left, right, from_left, active, hidden, top, both) if train else None

    def gradient(self, data: np.ndarray, starts: np.ndarray, truth: np.ndarray):
        logit, (where, chunks, first, left, right, from_left, active, hidden, top, both) = self.forward(data, starts, True)
        error = ((1 / (1 + np.exp(-logit)) - truth) / len(truth)).astype(np.float32)
        g = {"out": both.T @ error, "last": np.array([error.sum()], dtype=np.float32)}
        by_text = error[:, None] * self.p["out"]
        text = np.repeat(np.arange(len(chunks)), chunks)
        is_top = hidden == top[text]
        ties = np.add.reduceat(is_top.astype(np.float32), first[:-1], axis=0)
        d = is_top / ties[text] * by_text[text, :HIDDEN] + by_text[text, HIDDEN:] / chunks[text, None]
        d = d * (1 - hidden**2)
        g["dense"], g["bias"] = active.T @ d, d.sum(axis=0)
        d = (d @ self.p["dense"].T) * (1 - active**2) * 0.5
        g["shift"] = d.sum(axis=0)
        at = np.where(from_left, where[left], where[right])
        table = np.zeros_like(self.p["table"])
        filters = np.broadcast_to(np.arange(FILTERS), at.shape).ravel()
        for k in range(WIDTH):
            code = data[at.ravel() + k].astype(np.int64) * FILTERS + filters
            table[k] = np.bincount(code, weights=d.ravel(), minlength=257 * FILTERS).reshape(257, FILTERS)
        g["table"] = table
        return logit, g

    def fit(self, texts: list[bytes], truth: np.ndarray, seed: int = 9) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        t, steps = 0, EPOCHS * -(-len(texts) // STEP)
        for _ in range(EPOCHS):
            order = r.permutation(len(texts))
            for start in range(0, len(order), STEP):
                use = order[start : start + STEP]
                sizes = np.array([len(texts[i]) for i in use])
                data, starts = padded(np.frombuffer(b"".join(texts[i] for i in use), dtype=np.uint8), np.r_[0, np.cumsum(sizes)])
                _, g = self.gradient(data, starts, truth[use])
                t += 1
                rate = 0.02 * (1 - t / (steps + 1))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        self.freeze()

    def score(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each text."""
        logit, _ = self.forward(*padded(flat, offsets))
        return 1 / (1 + np.exp(-(logit.astype(np.float64) + self.prior)))


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> Network:
    """A network from rows outside fold 0 whose label is 0 or 1."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("quality in (0, 1) and doc_id is not null").where(fold(F.col("doc_id")) != 0)
    counts = {r.quality: r.n for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    net = Network()
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        net.p["out"][:] = 0
        net.prior = float(np.log((good + 1e-3) / (bad + 1e-3))) if good + bad else 0.0
        return net
    order = F.xxhash64("doc_id", F.lit(3))
    chosen = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text")
    rows = texts.where(size <= most_bytes // 8).join(F.broadcast(chosen.distinct()), "doc_id")  # per_class rows a class at most
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    so_far = F.sum(size).over(Window.partitionBy("quality").orderBy(order, "doc_id"))
    rows = rows.withColumn("so_far", so_far).where(F.col("so_far") <= most_bytes).orderBy("doc_id", "quality").collect()
    truth = np.array([r.quality for r in rows], dtype=np.float32)
    if len(set(truth.tolist())) == 2:
        whole = [r.text.encode() for r in rows]
        # Short ends of the same texts, so that a text isn't taken for poor because it is short.
        sizes = np.random.default_rng(4).integers(16, 256, size=len(whole))
        net.fit(whole + [w[-n:] for w, n in zip(whole, sizes.tolist())], np.r_[truth, truth])
        # Classes are trained in other shares than they have; the score answers to the labels' shares.
        net.prior = float(np.log(good / bad) - np.log(truth.mean() / (1 - truth.mean())))
    return net


def score_documents(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``score``, the probability of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(net)  # some 100 KB

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                found = shared.value.score(*flat_utf8(part, "text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(df: DataFrame, net: Network, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that score ``least`` or more."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    return keep_rows(df, text_col, lambda part: shared.value.score(*flat_utf8(part, text_col)) >= least, 1 << 20)
