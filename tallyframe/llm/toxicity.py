"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A text's words (runs of letters, A-Z lower-cased) are looked up in a table of ``BUCKETS`` embeddings by hashes: of the
word, and of its first 4, 5 and 6 bytes, which inflected forms share; a word's embedding is the mean of those. Filters over
1, 2 and 3 words (``WIDTHS``) run over the whole text, each is max-pooled over it, and a linear layer makes one
probability of the pooled values. A batch's distinct words are embedded once, and a filter's answers are sums of rows of small
tables, so each word costs a few lookups, however long the text is.

The network is trained by Spark on all labelled rows, whatever their number and length. Of texts that are near copies of each other the first by id
trains, so that the chance words of a text that was copied often don't pass for signs of its class: a text is left out if half of its
smallest hashes of 3 words are those of earlier texts. The others are dealt by their ids to shards of about ``SHARD`` bytes of text and
written once. The first coordinate of an embedding starts as the smoothed log odds of its bucket, counted over all training texts. In each of ``EPOCHS``
rounds every shard goes on from the shared network over all its texts, and the changes are averaged over the shards that made them, as whole
numbers, so that the order of sums doesn't matter. The driver gets the changed embeddings of a round, however many rows there are. Every fifth row by
a hash of its id is kept out of training: from the counts of those by language, class and logit (to 1/``BIN``) the probability is scaled, and a
threshold for each language is set where its F1 is best (``SUPPORT`` rows of either class needed, else the threshold of all languages
together). Language is never an input of the score.

A null or empty text gets the score of a text of padding; without training rows of both classes the score is the share of toxic
labels (0 without labels). Repeated rows are scored each; of labelled rows that repeat an id the text of the least hash trains,
once. A null language is one of its own. An empty table gives no row; other columns of the frame are not looked at.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._common import maybe_in, mixed, scratch, slices

#: What lies between words: all of ASCII but its letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Embeddings and their coordinates; words of a filter; filters a width; bytes of the prefixes that are hashed too.
BUCKETS, DIM, WIDTHS, FILTERS, PREFIXES = 1 << 17, 8, (1, 2, 3), 8, (4, 5, 6)
#: Bytes of text of a training shard, about. Rounds, texts a step and rate of training. Steps of one in sums and in logits.
SHARD, EPOCHS, STEP, RATE, UNIT, BIN = 16 << 20, 6, 32, 0.05, 1 << 20, 64
#: Slope of the rectifier below zero.
LEAK = 0.1
#: Texts that smooth a bucket's log odds.
SMOOTH = 3.0
#: Rows of either class that calibration needs; the threshold where there are fewer.
SUPPORT, PLAIN = 15, 0.5
#: Text bytes that are scored at once, and words that are convolved at once.
PIECE, WINDOW = 2 << 20, 1 << 16


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, each text's words as places among them, and the texts' offsets."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BETWEEN)
    coded = lists.flatten().dictionary_encode()
    rows, codes = pc.list_parent_indices(lists).to_numpy(), coded.indices.to_numpy()
    empty = pc.index(coded.dictionary, "").as_py() if len(coded.dictionary) else -1
    if empty >= 0:
        some = codes != empty
        rows, codes = rows[some], codes[some]
    return coded.dictionary, codes.astype(np.int64), np.r_[0, np.cumsum(np.bincount(rows, minlength=len(lists)))].astype(np.int64)


def hashed(words: pa.Array) -> np.ndarray:
    """The buckets of each word and of its prefixes: a row a word, ``BUCKETS`` where it has no such prefix."""
    held = words.cast(pa.large_binary())
    offsets = np.frombuffer(held.buffers()[1], dtype=np.int64)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(held.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max(initial=1)), np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)])
    at = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[at])]
    out = np.empty((len(size), 1 + len(PREFIXES)), dtype=np.int64)
    for i, n in enumerate((None, *PREFIXES)):
        long = size if n is None else np.minimum(size, n)
        key = mixed((sums[offsets[:-1] + long] - sums[offsets[:-1]]) ^ np.uint64(0xD1B54A32D192ED03 >> i))
        out[:, i] = (key >> np.uint64(20)) % np.uint64(BUCKETS)
        if n is not None:
            out[size < n, i] = BUCKETS
    return out


def sketches(codes: np.ndarray, offsets: np.ndarray, buckets: np.ndarray) -> list[np.ndarray]:
    """The 8 smallest hashes of 3 words of each text."""
    word = mixed(buckets[:, 0].astype(np.uint64) * np.uint64(BUCKETS) + buckets[:, 1].astype(np.uint64))
    out = []
    for i in range(len(offsets) - 1):
        w = word[codes[offsets[i] : offsets[i + 1]]]
        grams = w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7) if len(w) > 2 else w
        grams = mixed(grams)
        if len(grams) > 64:
            few = np.unique(np.partition(grams, 63)[:64])
            grams = few if len(few) >= 8 else grams
        out.append(np.unique(grams)[:8])
    return out


def distinct_texts(codes: np.ndarray, offsets: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Places of the texts that don't share 4 of their 8 smallest hashes of 3 words with earlier ones."""
    seen, keep = set(), []
    for i, least in enumerate(x.tolist() for x in sketches(codes, offsets, buckets)):
        if sum(x in seen for x in least) < max(1, min(4, len(least))):
            keep.append(i)
        seen.update(least)
    return np.array(keep, dtype=np.int64)


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.table = np.zeros((BUCKETS + 1, DIM), dtype=np.float32)  # the last row stays zero: no prefix, and padding
        self.table[:BUCKETS] = r.normal(size=(BUCKETS, DIM)) * 0.05
        self.filters = [(r.normal(size=(w, DIM, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[0, 0, : FILTERS // 2] += 1.0
        self.shift = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = np.tile(np.repeat(np.float32([0.3, 0]), [FILTERS // 2, FILTERS - FILTERS // 2]), len(WIDTHS))
        self.last = np.zeros(1, dtype=np.float32)
        self.slope, self.base = 1.0, 0.0

    def embed(self, buckets: np.ndarray) -> np.ndarray:
        """A word's embedding; one more row, of zeros, for padding."""
        total = self.table[buckets].sum(axis=1) / (buckets < BUCKETS).sum(axis=1, keepdims=True)
        return np.concatenate([total, np.zeros((1, DIM), dtype=np.float32)]).astype(np.float32)

    @staticmethod
    def padded(codes: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
        """Every text's words with a filter's width of padding after them, and where texts start."""
        extra, size = max(WIDTHS), np.diff(offsets)
        starts = np.r_[0, np.cumsum(size + extra)]
        out = np.full(int(starts[-1]) + extra, pad, dtype=np.int64)
        out[np.repeat(starts[:-1] - offsets[:-1], size) + np.arange(len(codes))] = codes
        return out, starts

    def pooled(self, embedded: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The largest answer of each filter in each text, ``WINDOW`` words at a time; no filter sees the next text."""
        crosses = np.zeros(int(starts[-1]), dtype=bool)
        crosses[(starts[1:, None] - np.arange(1, max(WIDTHS))).ravel()] = True
        taps = [[embedded @ f[k] for k in range(len(f))] for f in self.filters]
        high = np.full((len(starts) - 1, len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
        for a in range(0, int(starts[-1]), WINDOW):
            b = min(a + WINDOW, int(starts[-1]))
            text = int(np.searchsorted(starts, a, side="right")) - 1
            cuts = np.r_[a, starts[text + 1 : np.searchsorted(starts, b)]] - a
            for i, tap in enumerate(taps):
                total = tap[0].take(codes[a:b], axis=0)
                for k in range(1, len(tap)):
                    total += tap[k].take(codes[a + k : b + k], axis=0)
                total[crosses[a:b]] = -np.inf
                part = high[text : text + len(cuts), i * FILTERS : (i + 1) * FILTERS]
                np.maximum(part, np.maximum.reduceat(total, cuts, axis=0), out=part)
        return high

    def active(self, high: np.ndarray) -> np.ndarray:
        """A leaky rectifier of the pooled answers."""
        return np.where(high + self.shift > 0, 1.0, LEAK).astype(np.float32) * (high + self.shift)

    def answers(self, texts: pa.Array) -> np.ndarray:
        """The largest answer of each filter in each text."""
        words, codes, offsets = words_of(texts)
        padded, starts = self.padded(codes, offsets, len(words))
        return self.pooled(self.embed(hashed(words)), padded, starts)

    def logit(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        return (self.active(self.answers(texts)) @ self.out).astype(np.float64) + float(self.last[0])

    def score(self, texts: pa.Array) -> np.ndarray:
        """The probability of label 1 of each text."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logit(texts) + self.base, -700, 700)))

    def flat(self) -> np.ndarray:
        """All that is learned, as rows of ``DIM`` numbers: the embeddings, then the rest end to end."""
        rest = np.concatenate([x.ravel() for x in (*self.filters, self.shift, self.out, self.last)])
        return np.concatenate([self.table, np.resize(np.r_[rest, np.zeros(-len(rest) % DIM)], (-(-len(rest) // DIM), DIM))]).astype(np.float32)

    def learn(self, flat: np.ndarray) -> None:
        self.table, rest, at = flat[: BUCKETS + 1].copy(), flat[BUCKETS + 1 :].ravel(), 0
        for x in (*self.filters, self.shift, self.out, self.last):
            x[...] = rest[at : at + x.size].reshape(x.shape)
            at += x.size

    def fit(self, codes: np.ndarray, offsets: np.ndarray, buckets: np.ndarray, truth: np.ndarray, toxic: float, epoch: int, seed: int = 3) -> None:
        """A round of Adagrad on the logistic loss over some texts; only words at the largest answers of filters get a gradient.

        Classes weigh the same by ``toxic``, the share of toxic texts among all.
        """
        r, n, size = np.random.default_rng((seed, epoch)), len(truth), len(WIDTHS) * FILTERS
        weight = np.where(truth > 0.5, 0.5 / toxic, 0.5 / (1 - toxic)).astype(np.float32)
        seen = [np.full_like(x, 1e-2) for x in (self.table, *self.filters, self.shift, self.out, self.last)]

        def step(x: np.ndarray, g: np.ndarray, past: np.ndarray, rate: float) -> None:
            past += g * g
            x -= rate * g / np.sqrt(past)

        order, rate = r.permutation(n), RATE / (1 + epoch)
        for first in range(0, n, STEP):
            use = order[first : first + STEP]
            own = [codes[offsets[i] : offsets[i + 1]] for i in use]
            used, local = np.unique(np.concatenate(own), return_inverse=True)
            held = buckets[used]
            embedded = self.embed(held)
            padded, starts = self.padded(local.reshape(-1), np.r_[0, np.cumsum([len(x) for x in own])], len(used))
            places, high = np.empty((len(use), size), dtype=np.int64), np.empty((len(use), size), dtype=np.float32)
            for i, f in enumerate(self.filters):
                total = sum((embedded @ f[k]).take(padded[k : k + int(starts[-1])], axis=0) for k in range(len(f)))
                for t in range(len(use)):
                    mine = total[starts[t] : starts[t + 1] - max(WIDTHS) + 1]
                    at = mine.argmax(axis=0)
                    places[t, i * FILTERS : (i + 1) * FILTERS] = at + starts[t]
                    high[t, i * FILTERS : (i + 1) * FILTERS] = mine[at, np.arange(FILTERS)]
            active = self.active(high)
            answer = active @ self.out + self.last[0]
            error = ((1 / (1 + np.exp(-answer)) - truth[use]) * weight[use] / len(use)).astype(np.float32)
            d = error[:, None] * self.out * np.where(high + self.shift > 0, 1.0, LEAK)
            g_words = np.zeros((len(used) + 1, DIM), dtype=np.float32)
            g_filters = []
            for i, f in enumerate(self.filters):
                mine, at = d[:, i * FILTERS : (i + 1) * FILTERS], places[:, i * FILTERS : (i + 1) * FILTERS]
                g = np.empty_like(f)
                for k in range(len(f)):
                    word = padded[at + k]
                    g[k] = np.einsum("tf,tfd->df", mine, embedded[word])
                    np.add.at(g_words, word.ravel(), (mine[:, :, None] * f[k].T[None]).reshape(-1, DIM))
                g_filters.append(g)
            touched = np.flatnonzero(g_words[:-1].any(axis=1))
            share = g_words[touched] / (held[touched] < BUCKETS).sum(axis=1, keepdims=True)
            rows, place = np.unique(held[touched], return_inverse=True)
            g_rows = np.zeros((len(rows), DIM), dtype=np.float32)
            np.add.at(g_rows, place.reshape(-1), np.repeat(share, held.shape[1], axis=0))
            past = seen[0][rows] + g_rows**2
            seen[0][rows] = past
            self.table[rows] -= rate * g_rows / np.sqrt(past)
            self.table[BUCKETS] = 0
            for x, g, past in zip([*self.filters, self.shift, self.out, self.last], [*g_filters, d.sum(axis=0), active.T @ error, np.array([error.sum()])], seen[1:]):
                step(x, g.astype(np.float32), past, rate)

    def start(self, held: np.ndarray, classes: np.ndarray) -> None:
        """The first coordinate of each bucket: the smoothed log odds of its share of toxic and of other texts.

        ``held``: of both classes, other texts first, how many texts hold each bucket; ``classes``: how many texts there are.
        """
        n0, n1 = map(float, classes)
        # Smoothed by the classes' shares, so that a bucket without texts has odds of 1.
        odds = np.log((held[1] + SMOOTH * n1 / (n1 + n0)) / n1) - np.log((held[0] + SMOOTH * n0 / (n1 + n0)) / n0)
        self.table[:BUCKETS, 0] += odds

    def scale(self, logit: np.ndarray, truth: np.ndarray, rows: np.ndarray, odds: float) -> None:
        """Fit slope and base of the probability by weighted Newton steps; ``odds`` are those of the classes among all labels.

        ``rows``: how many rows have a logit and class.
        """
        share = (rows * truth).sum() / rows.sum()
        weight = rows * np.where(truth > 0.5, odds / (1 + odds) / share, 1 / (1 + odds) / (1 - share))
        x, w = np.stack([logit, np.ones_like(logit)], axis=1), np.array([1.0, np.log(odds)])
        start = w.copy()
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weight * (p - truth)) + 0.5 * (w - start)
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
            w = w - np.clip(np.linalg.solve(h, g), -1, 1)
        self.slope, self.base = float(max(w[0], 0.1)), float(w[1])


def best_threshold(score: np.ndarray, truth: np.ndarray, rows: np.ndarray) -> float:
    """Halfway between two scores, where F1 is best; of equal ones the largest. ``rows``: how many rows have a score and class."""
    score, place = np.unique(-score, return_inverse=True)
    score, place = -score, place.reshape(-1)
    hit = np.cumsum(np.bincount(place, weights=rows * (truth > 0.5)))
    f1 = 2 * hit / (np.cumsum(np.bincount(place, weights=rows)) + hit[-1])
    i = int(f1.argmax())
    return float((score[i] + (score[i + 1] if i + 1 < len(score) else 0.0)) / 2)


class Classifier:
    """A network and its thresholds by language."""

    def __init__(self, network: Network, threshold: float, by_lang: dict[str | None, float]):
        self.network, self.threshold, self.by_lang = network, threshold, by_lang


def fold(doc_id: Column, folds: int = 3) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``doc_id, toxic, text, lang, aside, shard`` of the labelled texts that train or calibrate, written once: a file a shard.

    ``known``: distinct ``doc_id`` and ``toxic``. Near copies are found by tables of hashes and ids; of texts only those that train are shuffled, once.
    """
    spark = docs.sparkSession
    lang = F.col(lang_col).cast("string").alias("lang") if lang_col in docs.columns else F.lit(None).cast("string").alias("lang")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), lang)
    texts = texts.where(maybe_in(known, "doc_id")(F.col("doc_id"))).select("*", F.xxhash64("text").alias("hash"))

    def least(batches):
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                words, codes, offsets = words_of(part.column("text"))
                found = sketches(codes, offsets, hashed(words))
                ends = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pc.cast(pc.binary_length(part.column("text")), pa.int64()), lists], names=["doc_id", "hash", "size", "least"])

    path = scratch(spark, "sketches")
    found = texts.select("doc_id", "hash", "text").mapInArrow(least, "doc_id long, hash long, size long, least array<long>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("hash", "size", "least")).alias("s")).join(known, "doc_id").select("doc_id", "toxic", "s.*")
    found.write.parquet(path)
    found = spark.read.parquet(path)
    # A hash is its first text's; a text without enough hashes of its own is a near copy.
    first = found.select("doc_id", "toxic", F.size("least").alias("n"), F.explode("least").alias("h")).groupBy("h").agg(F.min(F.struct("doc_id", "toxic", "n")).alias("t"))
    own = first.groupBy("t").agg(F.count("*").alias("own")).where("t.n - own < greatest(1, least(4, t.n))").select("t.doc_id", "t.toxic")
    bare = found.where(F.size("least") == 0).select("doc_id", "toxic")
    kept = own.unionByName(bare).join(found.select("doc_id", "toxic", "hash", "size"), ["doc_id", "toxic"])
    path = scratch(spark, "kept")
    kept.write.parquet(path)
    kept = spark.read.parquet(path)

    shards = max(1, -(-(kept.agg(F.sum("size")).first()[0] or 0) // SHARD))
    # Dealt by the id alone, which the join, the grouping and the files share; hashes are compared after it.
    chosen = kept.select("doc_id", "toxic", F.col("hash").alias("own")).repartition(shards, "doc_id")
    rows = texts.repartition(shards, "doc_id").join(chosen, "doc_id").where(F.col("hash").bitwiseXOR(F.col("own")) == 0).groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("t"))
    aside, shard = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 4, F.spark_partition_id()  # Spark may join in more parts than asked for; each is a shard
    path = scratch(spark, "training")
    rows.select("doc_id", "toxic", "t.*", aside.alias("aside"), shard.alias("shard")).sortWithinPartitions("shard", "doc_id", "toxic").write.parquet(path)
    return spark.read.parquet(path)


def by_shard(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work`` makes of the rows of each shard, which lie together in a file."""

    def run(batches):
        held, shard = [], None
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(numbers)) + 1, len(numbers)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                if held and numbers[a] != shard:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                shard = numbers[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """Of other and of toxic texts, how many hold each bucket."""

    def work(held):
        counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for batch in held.combine_chunks().to_batches():
            for part in slices(batch, "text", PIECE):
                words, codes, offsets = words_of(part.column("text"))
                buckets = hashed(words)
                texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                text, word = np.divmod(np.unique(texts * len(words) + codes), max(1, len(words)))
                text, bucket = np.divmod(np.unique((text[:, None] * (BUCKETS + 1) + buckets[word]).ravel()), BUCKETS + 1)
                for c in (0, 1):
                    counts[c] += np.bincount(bucket[part.column("toxic").to_numpy()[text] == c], minlength=BUCKETS + 1)
        at = np.flatnonzero(counts[:, :BUCKETS].any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["at", "c0", "c1"])

    found = by_shard(rows.select("shard", "toxic", "text"), work, "at long, c0 long, c1 long").groupBy("at").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toArrow()
    out = np.zeros((2, BUCKETS), dtype=np.int64)
    for c in (0, 1):
        out[c, found["at"].to_numpy()] = found[f"c{c}"].to_numpy()
    return out


def mean_answers(rows: DataFrame, network: Network) -> np.ndarray:
    """The mean over all texts of each filter's largest answer."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def work(held):
        total = np.zeros(len(WIDTHS) * FILTERS, dtype=np.int64)
        for batch in held.combine_chunks().to_batches():
            for part in slices(batch, "text", PIECE):
                total += np.round(shared.value.answers(part.column("text")) * UNIT).astype(np.int64).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), held.num_rows))], names=["at", "v", "n"])

    found = by_shard(rows.select("shard", "text"), work, "at long, v long, n long").groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("at").collect()
    return np.array([r.v / r.n / UNIT for r in found], dtype=np.float32)


def trained(rows: DataFrame, network: Network, toxic: float, epoch: int) -> np.ndarray:
    """The network's numbers after a round: every shard's changes, averaged over the shards that change a row."""
    shared = rows.sparkSession.sparkContext.broadcast(network)
    names = [f"d{i}" for i in range(DIM)]

    def work(held):
        net, old = copy.deepcopy(shared.value), shared.value.flat()
        words, codes, offsets = words_of(held.combine_chunks().column("text").combine_chunks())
        net.fit(codes, offsets, hashed(words), held["toxic"].to_numpy().astype(np.float32), toxic, epoch)
        change = np.round((net.flat() - old) * np.float64(UNIT)).clip(-(2**31) + 1, 2**31 - 1).astype(np.int32)
        at = np.flatnonzero(change.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(change[at, i]) for i in range(DIM))], names=["at", *names])

    found = by_shard(rows.select("shard", "toxic", "text"), work, ", ".join(["at int", *(f"{d} int" for d in names)]))
    found = found.groupBy("at").agg(F.count("*").alias("n"), *(F.sum(d).alias(d) for d in names)).toArrow()  # rows of embeddings, however many texts
    out = network.flat().astype(np.float64)
    at = found["at"].to_numpy()
    out[at] += np.stack([found[d].to_numpy() for d in names], axis=1) / found["n"].to_numpy()[:, None] / UNIT
    return out.astype(np.float32)


def logit_counts(rows: DataFrame, network: Network) -> DataFrame:
    """``lang, toxic, bin, n``: how many rows of each language and class have a logit, in steps of 1/``BIN``."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                bins = np.round(shared.value.logit(part.column("text")) * BIN).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("toxic"), pa.array(bins)], names=["lang", "toxic", "bin"])

    return rows.select("lang", "toxic", "text").mapInArrow(run, "lang string, toxic int, bin long").groupBy("lang", "toxic", "bin").agg(F.count("*").alias("n"))


def train(
    docs: DataFrame, labels: DataFrame, held_out: int = 1, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Classifier:
    """A classifier from all rows outside fold ``held_out`` whose label is 0 or 1."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where("toxic in (0, 1) and doc_id is not null").where(fold(F.col("doc_id")) != held_out)
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    net = Network()
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        net.slope, net.base = 0.0, float(np.log((toxic + 1e-3) / (clean + 1e-3))) if toxic + clean else -700.0
        return Classifier(net, PLAIN, {})
    rows = training_rows(docs, known.distinct(), id_col, text_col, lang_col)
    sizes = {(r.aside, r.toxic): r.n for r in rows.groupBy("aside", "toxic").agg(F.count("*").alias("n")).collect()}
    few = min(sizes.get((True, c), 0) for c in (0, 1)) < SUPPORT
    trains = rows if few else rows.where("not aside")
    classes = np.array([sizes.get((False, c), 0) + (sizes.get((True, c), 0) if few else 0) for c in (0, 1)])
    if not classes.all():
        net.slope, net.base = 0.0, float(np.log(toxic / clean))
        return Classifier(net, PLAIN, {})

    net.start(bucket_counts(trains), classes)
    net.shift = -mean_answers(trains, net)  # filters answer to what is above their mean over all texts
    for epoch in range(EPOCHS):
        net.learn(trained(trains, net, float(classes[1] / classes.sum()), epoch))
    if few:
        net.base = float(np.log(toxic / clean))
        return Classifier(net, PLAIN, {})
    found = logit_counts(rows.where("aside"), net).orderBy("lang", "toxic", "bin").collect()  # a row a language, class and step of logits
    logit, truth, n = (np.array([r[c] for r in found], dtype=np.float64) for c in ("bin", "toxic", "n"))
    logit /= BIN
    net.scale(logit, truth, n, toxic / clean)
    score, langs, by_lang = 1 / (1 + np.exp(-(net.slope * logit + net.base))), np.array([r.lang for r in found], dtype=object), {}
    for name in sorted({x for x in langs}, key=str):
        mine = langs == name
        if min(n[mine][truth[mine] == c].sum() for c in (0, 1)) >= SUPPORT:
            by_lang[name] = best_threshold(score[mine], truth[mine], n[mine])
    return Classifier(net, best_threshold(score, truth, n), by_lang)


def score_documents(df: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: ``doc_id``, ``score``, the language's ``threshold``, and ``flagged``, whether the score reaches it."""
    shared = df.sparkSession.sparkContext.broadcast(classifier)  # the table of embeddings, some 4 MB

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                held = shared.value
                score = held.network.score(part.column("text"))
                least = np.array([held.by_lang.get(x, held.threshold) for x in part.column("lang").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(score), pa.array(least), pa.array(score >= least)], names=["doc_id", "score", "threshold", "flagged"]
                )

    lang = F.col(lang_col).cast("string").alias("lang") if lang_col in df.columns else F.lit(None).cast("string").alias("lang")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang)
    return rows.mapInArrow(run, "doc_id long, score double, threshold double, flagged boolean")
