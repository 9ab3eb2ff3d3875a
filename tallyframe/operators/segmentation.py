"""Word breaks by vocabularies of any size: tries of word shards, and a cover of each value from their hits.

A word's code is its first ``PREFIX`` bytes; where too many words share a code, those go by their longest common prefix and the byte after it, again
and again until no code has more than ``1 / PARTS`` of a shard's words. So at any place of a value one code fits. Words are dealt to shards of about ``words_a_shard``
by a hash of their codes, words that are shorter than theirs to all shards. A value goes to the shards of the codes at its places that words have; a shard meets
its own values only, ``VALUES`` at a time, so work grows with words and values, not with their product. There a trie, one sorted array of
(node, byte) keys, is walked from all places of all values at once, level by level, which finds every word at every place. Hits of all shards meet
by value, and the cover is found from left to right. One plan serves all sizes; words and values never reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.sources import files

#: Bytes of a code at least; codes that fill a shard; distinct values that meet a shard at once, about; bytes of values that are walked at once.
PREFIX, PARTS, VALUES, WALKED = 3, 8, 50_000, 1 << 20
#: Bits of the table of the codes that words have.
BITS = 63 << 16


class Trie:
    """The distinct prefixes of some words are nodes, numbered by length and order; edge i leads to node i + 1."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        size, at, node = np.diff(offsets), offsets[:-1], np.zeros(len(offsets) - 1, dtype=np.int64)
        edges, ends, known, depth = [], [], 0, 0
        at, node, size = at[size > 0], node[size > 0], size[size > 0]
        while len(at):
            keys, place = np.unique(node * 256 + flat[at + depth], return_inverse=True)
            edges.append(keys)
            node = known + place.reshape(-1) + 1
            known += len(keys)
            depth += 1
            ends.append(node[size == depth])
            longer = size > depth
            at, node, size = at[longer], node[longer], size[longer]
        self.edges = np.concatenate(edges) if edges else np.empty(0, dtype=np.int64)
        self.word = np.zeros(known + 1, dtype=bool)
        self.word[np.concatenate(ends) if ends else np.empty(0, dtype=np.int64)] = True

    def hits(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end in some values, as places in ``flat``; no word crosses from a value into the next."""
        start, stop = np.arange(offsets[0], offsets[-1]), np.repeat(offsets[1:], np.diff(offsets))
        node, found, depth = np.zeros(len(start), dtype=np.int64), [], 0
        while len(start) and len(self.edges):
            key = node * 256 + flat[start + depth]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = self.edges[edge] == key
            start, stop, node, depth = start[on], stop[on], edge[on] + 1, depth + 1
            found.append(np.stack([start, start + depth])[:, self.word[node]])
            more = start + depth < stop
            start, stop, node = start[more], stop[more], node[more]
        both = np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)
        return both[0], both[1]

    def longest(self, flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How long the longest word is that starts at each place and ends by its stop; 0 where none does."""
        out, live, depth = np.zeros(len(start), dtype=np.int64), np.flatnonzero(start < stop), 0
        node = np.zeros(len(live), dtype=np.int64)
        while len(live) and len(self.edges):
            key = node * 256 + flat[start[live] + depth]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            on = self.edges[edge] == key
            live, node, depth = live[on], edge[on] + 1, depth + 1
            out[live[self.word[node]]] = depth
            more = start[live] + depth < stop[live]
            live, node = live[more], node[more]
        return out


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    held = texts.cast(pa.large_binary())
    if not len(held):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(held.buffers()[1], dtype=np.int64)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(held.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _met(words: pa.Table, values: pa.Table) -> pa.Table:
    """``value, hits``: the (start, end) pairs, end to end, of a shard's words in its values; values without any are left out."""
    trie, texts = Trie(*_bytes_of(pc.unique(words["atom"]))), values["value"].combine_chunks()
    flat, offsets = _bytes_of(texts)
    out, first = [], 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + WALKED, side="right")) - 1)
        start, end = trie.hits(flat, offsets[first : last + 1])
        which = np.searchsorted(offsets, start, side="right") - 1
        order = np.argsort(which, kind="stable")
        which, start, end = which[order], start[order], end[order]
        rows, begins = np.unique(which, return_index=True)
        pairs = (np.stack([start, end], axis=1) - offsets[which][:, None]).astype(np.int32).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.r_[2 * begins, len(pairs)].astype(np.int32)), pa.array(pairs))
        out.append(pa.table({"value": texts.take(pa.array(rows)), "hits": lists}))
        first = last
    return pa.concat_tables(out) if out else pa.table({"value": pa.array([], pa.string()), "hits": pa.array([], pa.list_(pa.int32()))})


def cover(value: bytes, hits: np.ndarray) -> list[str] | None:
    """Words that cover the whole value; of the words that end at a place and start where a cover ends, the one that starts earliest is taken."""
    starts: dict[int, list[int]] = {}
    for start, end in sorted(set(zip(hits[::2].tolist(), hits[1::2].tolist()))):
        starts.setdefault(end, []).append(start)
    back, size = {0: 0}, len(value)
    for end in sorted(starts):
        found = next((s for s in starts[end] if s in back), None)
        if found is not None:
            back[end] = found
    if not size or size not in back:
        return None
    out, end = [], size
    while end:
        out.append(value[back[end] : end].decode())
        end = back[end]
    return out[::-1]


def _codes(trie: Trie, flat: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places at which a whole code lies, its length and its hash; ``trie`` holds the prefixes that too many words share."""
    shared = trie.longest(flat, start, stop)
    size = np.where(shared > 0, shared + 1, PREFIX)
    whole = np.flatnonzero(start + size <= stop)
    at, size = start[whole], size[whole]
    base = 0x9E3779B97F4A7C15
    power, back = (np.cumprod(np.r_[np.uint64(1), np.full(len(flat), np.uint64(x), dtype=np.uint64)]) for x in (base, pow(base, -1, 1 << 64)))
    sums = np.r_[np.uint64(0), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[:-1])]
    h = (sums[at + size] - sums[at]) * back[at]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return whole, size, h ^ (h >> np.uint64(32))


def _pieces(texts: pa.Array):
    """Parts of some texts of ``WALKED`` bytes at most, or one text: the bytes and the offsets."""
    first, ends = 0, _bytes_of(texts)[1]
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + WALKED, side="right")) - 1)
        yield texts.slice(first, last - first), *_bytes_of(texts.slice(first, last - first))
        first = last


def shared_prefixes(atoms: DataFrame, most: int) -> list[bytes]:
    """The common prefixes of words that go on by one more byte, as their codes would have more than ``most`` words."""
    atom, out = F.col("atom").cast("binary"), []
    counted = lambda df: df.groupBy("code").agg(F.count("*").alias("n"), F.min("b").alias("low"), F.max("b").alias("high")).where(F.col("n") > most).collect()
    found = counted(atoms.where(F.octet_length("atom") >= PREFIX).select(F.substring(atom, 1, PREFIX).alias("code"), atom.alias("b")))
    while found:
        for r in found:
            pairs = zip(r.low, r.high)
            out.append(bytes(r.low[: next((i for i, (x, y) in enumerate(pairs) if x != y), min(len(r.low), len(r.high)))]))
        trie = _trie(out)

        def coded(batches, trie=trie):
            for batch in batches:
                for part, flat, offsets in _pieces(batch.column("b")):
                    whole, size, _ = _codes(trie, flat, offsets[:-1], offsets[1:])
                    yield pa.RecordBatch.from_arrays([part.take(pa.array(whole)), pa.array(size)], names=["b", "size"])

        words = atoms.select(atom.alias("b")).mapInArrow(coded, "b binary, size long").where(F.col("size") > PREFIX)
        found = counted(words.select(F.substring("b", F.lit(1), F.col("size").cast("int")).alias("code"), "b"))
    return out


def _trie(words: list[bytes]) -> Trie:
    return Trie(*_bytes_of(pa.array(words, type=pa.binary())))


def _written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from the shared folder, as several jobs read them."""
    path = files.shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def segments(values: DataFrame, words: DataFrame, words_a_shard: int) -> DataFrame:
    """``value, parts``: the word break of every distinct ``value`` by the words of ``atom``; no row where no cover exists."""
    spark = values.sparkSession
    atoms = _written(words.select(F.col("atom").cast("string").alias("atom")).where("atom != ''").distinct(), "atoms")
    texts = _written(values.select("value").where("value is not null and value != ''").distinct(), "values")
    shards = max(1, -(-atoms.count() // words_a_shard))
    trie = spark.sparkContext.broadcast(_trie(shared_prefixes(atoms, max(1, words_a_shard // PARTS)) if shards > 1 else []))

    def placed(batches):
        for batch in batches:
            for part, flat, offsets in _pieces(batch.column("atom")):
                whole, _, h = _codes(trie.value, flat, offsets[:-1], offsets[1:])
                shard, bit = np.full(len(part), -1), np.full(len(part), -1)
                shard[whole], bit[whole] = h % np.uint64(shards), h % np.uint64(BITS)
                yield pa.RecordBatch.from_arrays([part, pa.array(shard), pa.array(bit)], names=["atom", "shard", "bit"])

    coded = atoms.mapInArrow(placed, "atom string, shard long, bit long")
    found = coded.where("bit >= 0").groupBy(F.floor(F.col("bit") / 63).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 63 as int))")).alias("v")).toArrow()  # some 65,000 rows at most
    bits = np.zeros(BITS // 63, dtype=np.int64)
    bits[found["w"].to_numpy()] = found["v"].to_numpy()
    held, short = spark.sparkContext.broadcast(bits), coded.where("shard < 0").limit(1).count() > 0

    def sent(batches):
        for batch in batches:
            for part, flat, offsets in _pieces(batch.column("value")):
                whole, _, h = _codes(trie.value, flat, np.arange(len(flat)), np.repeat(offsets[1:], np.diff(offsets)))
                w, bit = np.divmod((h % np.uint64(BITS)).astype(np.int64), 63)
                on = (held.value[w] >> bit & 1) == 1
                row = np.searchsorted(offsets, whole[on], side="right") - 1
                pairs = np.unique(row * shards + (h[on] % np.uint64(shards)).astype(np.int64))
                # Words that are shorter than their codes lie in every shard; a value without codes asks the first one for them.
                pairs = np.r_[pairs, np.setdiff1d(np.arange(len(part)), row) * shards] if short else pairs
                yield pa.RecordBatch.from_arrays([part.take(pa.array(pairs // shards)), pa.array(pairs % shards)], names=["value", "shard"])

    asked = texts.mapInArrow(sent, "value string, shard long")
    sizes = asked.groupBy("shard").agg(F.count("*").alias("n")).collect()  # a row a shard
    buckets = spark.createDataFrame([(r.shard, -(-r.n // VALUES)) for r in sizes], "shard long, buckets long")
    every = F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")
    dealt = coded.select("atom", F.explode(F.when(F.col("shard") < 0, every).otherwise(F.array("shard"))).alias("shard")).join(F.broadcast(buckets), "shard")  # a row a shard
    dealt = dealt.select("atom", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    asked = asked.join(F.broadcast(buckets), "shard").select("value", "shard", F.pmod(F.xxhash64("value"), F.col("buckets")).alias("bucket"))
    met = dealt.groupBy("shard", "bucket").cogroup(asked.groupBy("shard", "bucket")).applyInArrow(_met, "value string, hits array<int>")

    def covered(batches):
        for batch in batches:
            parts = [cover(v.encode(), np.array(h, dtype=np.int64)) for v, h in zip(batch.column("value").to_pylist(), batch.column("hits").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(parts, type=pa.list_(pa.string()))], names=["value", "parts"])

    hits = met.groupBy("value").agg(F.flatten(F.collect_list("hits")).alias("hits"))  # a list a shard that the value holds
    return hits.mapInArrow(covered, "value string, parts array<string>").where("parts is not null")
