"""N-gram Jaccard join with set-relation skipping, down to connected components.

A text's set is that of its k-word shingles (64-bit hashes of lower-cased words; with fewer words, the
whole sequence is one). Equal sets are one node from the start, by a 64-bit digest. Steps:

1. Groups that hold every link: the range of shingle hashes is cut into so many parts that two sets at
   the threshold agree on nine parts at least, whatever their differences. Sets that agree on a
   part are tied to one of them, so a part shared by m sets gives m edges; parts that very many sets
   share are split by salts. Texts that only share passages agree on no part, and aren't tied. Nearly all
   parts are one set's alone, so first only 40-bit prints of their keys are shuffled, three bytes each, and a
   bit for each of up to 2**``TWICE`` values says which occur twice; only those keys are sent with their sets.
2. A set of which too few shingles occur twice in its group can't have a partner and leaves. Prints of the
   shingles say which occur twice, as those of part keys do; a clash lets a set stay, it never drops one.
3. Each set is compared exactly with the one set that it is tied to by most parts. Sets that link so are
   one block. In a group of one block nothing is left to find; else a set goes on that shares enough
   shingles with other blocks than its own, and every further link has an end outside the group's
   largest block, so only those sets look for partners.
4. Inside a group the sets are joined exactly (``Relations``): index lists ordered by position, of which the
   tail that cannot reach the threshold is skipped; and the answers of a set close to one just computed
   are derived from that one's by the triangle inequality of the Jaccard distance, without the index. Past
   ``GROUP_SHINGLES`` the largest block is dealt to pieces, and the other sets meet each of them; where
   those alone are past it, all pairs of pieces meet.
5. Linked blocks are contracted to components, and components named by their smallest ``doc_id``.

Null and empty texts have empty sets, link with nothing and are their own component. Null ids count as
documents but never name a component (a component of null ids only has a null name). Rows that repeat
are equal sets; a set's text is found by id and text digest, so ids that repeat do no harm. An empty table
gives no row; other columns of the frame are not looked at. A very long text is worked on alone. Nothing
is capped. Hashes can err: for unequal sets to share a digest, or for all agreeing parts of a pair to be
empty (they aren't sent), has a chance below one in 10**9 for the largest corpora.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm._common import cut, flat_utf8, freed, id_and_text, maybe_in, mixed, slices
from tallyframe.llm.rules import SLICE, Rolling, words_of

#: Ratio of set sizes within a class; parts beyond those that differences can spoil, for small sets and others.
RATIO, SPARE_SMALL, SPARE = 1.6, 64, 8
#: A part key with this share of all keys, by a sample of one node in SAMPLE, is salted.
SAMPLE, FREQUENT, SALTS = 64, 1e-5, 64
#: Bits of the print of a key (of a part, or of a group's shingle); of its place in a table of keys seen twice, at most; keys that a task packs together; shingles, as a power of two, whose keys make a range.
PRINT, TWICE, PACKED, RANGE = 40, 28, 1 << 20, 21
#: The code, of three bytes, that steps on without a print.
ON = (1 << 24) - 1
#: Shingles that one task joins at once; a group with more is cut into pieces.
GROUP_SHINGLES = 1 << 20
#: A set within this distance of a computed one derives its answers from it.
CLOSE = 0.05
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(flat: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    row, _, hashes = words_of(_LOWER[flat], offsets)
    words = Rolling(hashes)
    at = np.searchsorted(row, np.arange(len(offsets)))
    count = np.diff(at)
    whole = np.arange(max(0, len(row) - k + 1))
    grams = words.of(whole, whole + k)
    short = np.flatnonzero((count > 0) & (count < k))
    alone = dict(zip(short.tolist(), words.of(at[short], at[short] + count[short])))
    out = []
    for i, (start, n) in enumerate(zip(at[:-1].tolist(), count.tolist())):
        out.append(np.unique(grams[start : start + n - k + 1]) if n >= k else np.array([alone[i]] if n else [], dtype=np.uint64))
    return out


def first_ones(n: int, percent: int) -> int:
    """How many shingles of a set of n any set at ``percent`` must share one of."""
    return n - -(-percent * n // 100) + 1 if n else 0


def digest(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def classes(percent: int, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """The first size of each class, and the number of parts in it.

    Class c also takes sets of the next class that a set of its own may link with. Of sets x and y,
    the smaller x in class c, at most ``|x| (100 - percent) / percent`` shingles differ.
    """
    first = [1]
    while first[-1] < most:
        first.append(max(first[-1] + 1, int(first[-1] * RATIO)))
    starts = np.array(first, dtype=np.int64)
    largest = starts[1:] - 1
    differ = largest * (100 - percent) // percent
    return starts, differ + 1 + np.where(largest <= 16, SPARE_SMALL, SPARE)


def part_keys(hashes: np.ndarray, starts: np.ndarray, parts: np.ndarray, percent: int) -> np.ndarray:
    """A key for each part of a set (ascending hashes) that isn't empty, in its class and those below that hold sets it may link with."""
    n = len(hashes)
    if not n:
        return np.empty(0, dtype=np.uint64)
    own = int(np.searchsorted(starts, n, side="right")) - 1
    spread, out = mixed(hashes), []
    for c in range(own, -1, -1):
        if percent * n > 100 * (int(starts[c + 1]) - 1):
            break
        part = ((hashes >> np.uint64(32)) * np.uint64(parts[c])) >> np.uint64(32)
        cut_ = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        with np.errstate(over="ignore"):
            out.append(mixed(np.add.reduceat(spread, cut_) ^ mixed(part[cut_] + np.uint64(c << 48))))
    return np.concatenate(out)


def packed(prints: np.ndarray) -> bytes:
    """Ascending prints, repeats too, as steps of three bytes from 0 on."""
    on, rest = np.divmod(np.diff(prints.astype(np.int64), prepend=0), ON)
    codes = np.full(len(prints) + int(on.sum()), ON, dtype="<u4")
    codes[np.cumsum(on + 1) - 1] = rest
    return codes.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    codes = np.zeros((len(data) // 3, 4), dtype=np.uint8)
    codes[:, :3] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3)
    codes = codes.view("<u4")[:, 0]
    return np.cumsum(codes, dtype=np.int64)[codes != ON]


def keys_twice(rows: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], shingles_: int) -> tuple[np.ndarray, int]:
    """A bit for each value of the first bits of a key, set where a print occurs twice, and how many bits those are; 2**TWICE / 8 bytes at most reach the driver.

    ``keys`` gives the keys of a task's rows. A range of prints is a group, of about 2**RANGE of ``shingles_``.
    """
    power = max(1, shingles_).bit_length()
    first = min(max(power, 13), TWICE)
    cuts = min(max(power - RANGE, 0), first - 3)
    within = PRINT - cuts

    def prints(batches):
        def sent(held):
            found = np.concatenate(held).view(np.int64)
            found.sort()
            at = np.searchsorted(found, np.arange((1 << cuts) + 1) << within)
            of = np.flatnonzero(at[1:] > at[:-1])
            data = [packed(found[at[r] : at[r + 1]] - (r << within)) for r in of.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(data, type=pa.binary())], names=["range", "prints"])

        held, size = [], 0
        for found in keys(batches):
            held.append(found >> np.uint64(64 - PRINT))
            size += len(found)
            if size > PACKED:
                yield sent(held)
                held, size = [], 0
        if size:
            yield sent(held)

    def both(key, found):
        prints = np.sort(np.concatenate([unpacked(x) for x in found.column("prints").to_pylist()]))
        bits = np.zeros(1 << (first - cuts), dtype=bool)
        bits[prints[1:][prints[1:] == prints[:-1]] >> (PRINT - first)] = True
        return pa.table({"range": pa.array([key[0].as_py()], type=pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], type=pa.binary())})

    out = np.zeros((1 << first) // 8, dtype=np.uint8)
    with freed(rows.sparkSession):
        found = rows.select("*").mapInArrow(prints, "range int, prints binary").groupBy("range").applyInArrow(both, "range int, bits binary").collect()
    size = len(out) >> cuts
    for r in found:
        out[r.range * size : (r.range + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out, first


def of_group(hashes: np.ndarray, root: int) -> np.ndarray:
    """Keys of a group's shingles, others in each group."""
    return mixed(hashes ^ mixed(np.array([root], dtype=np.int64).view(np.uint64)))


def twice_in(table: np.ndarray, first: int, keys: np.ndarray) -> np.ndarray:
    """Which keys the table says occur twice; of those that do, all."""
    at = keys >> np.uint64(64 - first)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Relations:
    """The exact join inside one group of sets."""

    def __init__(self, sets: list[np.ndarray], percent: int, block: np.ndarray | None = None, asks: np.ndarray | None = None):
        """``sets`` of ascending hashes. Inside, shingles are ordered by how many of the sets hold them.

        Sets with one number in ``block`` are known to be in one component; only those in ``asks`` look for partners.
        """
        self.percent, self.t = percent, percent / 100
        self.loose = max(1, int(100 * (self.t - CLOSE)))
        self.size = np.array([len(s) for s in sets])
        self.offset = np.r_[0, np.cumsum(self.size)]
        _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), dtype=np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        of = np.repeat(np.arange(len(sets)), self.size)
        self.token = np.sort(of * len(counts) + rank[token]) - of * len(counts)
        self.mark = np.zeros(int(self.token.max()) + 1 if len(self.token) else 1, dtype=bool)
        self.root = np.arange(len(sets))
        if block is not None:
            _, first, own = np.unique(block, return_index=True, return_inverse=True)
            self.root = first[own]
        self.asks = np.ones(len(sets), dtype=bool) if asks is None else asks
        head = np.array([min(n, first_ones(n, self.loose)) for n in self.size.tolist()])
        owner = np.repeat(np.arange(len(sets)), head)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(head) - head, head)
        token = self.token[self.offset[owner] + place]
        order = np.lexsort((place, token))
        self.listed, self.place = owner[order], place[order]
        self.start = np.searchsorted(token[order], np.arange(len(self.mark) + 1))
        self.head = head

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.root[max(i, j)] = min(i, j)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """The size of the intersection of set i and each other set."""
        own = self.token[self.offset[i] : self.offset[i + 1]]
        self.mark[own] = True
        n = self.size[others]
        ends = np.cumsum(n)
        at = np.repeat(self.offset[others] - (ends - n), n) + np.arange(int(ends[-1]))
        found = np.add.reduceat(self.mark[self.token[at]].astype(np.int64), ends - n)
        self.mark[own] = False
        return found

    def probe(self, i: int) -> np.ndarray:
        """Sets that may be at the loose threshold of set i, through the index."""
        n, t = int(self.size[i]), self.loose / 100
        far = (n / t - t * n) / (1 + t)  # no set that holds the token later than this can have enough in common
        out = []
        for token in self.token[self.offset[i] : self.offset[i] + self.head[i]].tolist():
            a, b = self.start[token], self.start[token + 1]
            if b - a > 1:
                out.append(self.listed[a : a + np.searchsorted(self.place[a:b], far + 1e-6, side="right")])
        found = np.unique(np.concatenate(out)) if out else np.empty(0, dtype=np.int64)
        size = self.size[found]
        return found[(found != i) & (100 * size >= self.loose * n) & (100 * n >= self.loose * size)]

    def run(self) -> np.ndarray:
        """The smallest member of each set's component."""
        done = ~self.asks
        for i in np.argsort(self.size, kind="stable").tolist():
            if done[i]:
                continue
            done[i] = True
            found = self.probe(i)
            if not len(found):
                continue
            both = self.common(i, found)
            union = self.size[i] + self.size[found] - both
            for j in found[100 * both >= self.percent * union].tolist():
                self.union(i, j)
            far = 1 - both / union
            keep = far <= 1 - self.t + CLOSE + 1e-9
            found, far = found[keep], far[keep]
            mine = self.find(i)
            outside = np.array([self.find(j) != mine for j in found.tolist()], dtype=bool)
            for j, d in zip(found[far <= CLOSE].tolist(), far[far <= CLOSE].tolist()):
                if done[j]:
                    continue
                done[j] = True
                # Whatever j links with lies within d + (1 - t) of i; what is in its component needs no look.
                rest = found[outside & (far <= d + 1 - self.t + 1e-9)] if outside.any() else found[:0]
                rest = np.array([r for r in rest.tolist() if self.find(r) != self.find(j)], dtype=np.int64)
                if len(rest):
                    both = self.common(j, rest)
                    for r in rest[100 * both >= self.percent * (self.size[j] + self.size[rest] - both)].tolist():
                        self.union(j, r)
        return np.array([self.find(i) for i in range(len(self.size))])


def contract(edges: DataFrame) -> DataFrame:
    """Connected components of edges ``a, b``: ``node, root``, the root being the smallest node.

    Each round every node points at the smallest node around it, and edges move to what their ends
    point at; every second node at least drops out of the edges. Edges and labels are checkpointed.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    labels = None
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        up = point.select(F.col("a").alias("to"), F.col("to").alias("top"))
        point = cut(point.join(up, "to", "left").select("a", F.coalesce("top", "to").alias("to")))
        if labels is None:
            labels = point.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            labels = labels.join(point, labels.root == point.a, "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = cut(labels)
        left = edges.join(point, "a").select(F.col("to").alias("x"), "b")
        moved = left.join(point.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").select("x", "y").where("x != y")
        edges = cut(moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` long, ``text_key`` long (the text's xxhash64) and ``group`` long (one of the component's sets)."""
    rows = id_and_text(df, id_col, text_col)
    starts, parts = classes(percent)

    def describe(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = shingles(*flat_utf8(part, "text"), k)
                columns = [pa.array(x, type=pa.int64()) for x in ([digest(s) for s in found], [len(s) for s in found])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), *columns], names=["doc_id", "text_key", "sig", "n"])

    def new_keys(batches):
        seen: set[int] = set()  # a set's keys are sent once a task; more copies of them do no harm
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                new = {digest(s): s for s in shingles(*flat_utf8(part, "text"), k)}
                new = {sig: part_keys(s, starts, parts, percent) for sig, s in new.items() if len(s) and sig not in seen}
                seen.update(new)
                yield list(new), [len(x) for x in new.values()], np.concatenate([*new.values(), np.empty(0, dtype=np.uint64)])

    def keys_of(batches, kept=lambda keys: np.ones(len(keys), dtype=bool)):
        for sigs, sizes, keys in new_keys(batches):
            ok = kept(keys)
            columns = [np.repeat(np.array(sigs, dtype=np.int64), sizes)[ok], keys[ok].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "key"])

    def shared_keys_of(batches):
        return keys_of(batches, lambda keys: twice_in(twice_.value, first, keys))

    # More than one pass over the texts: keys are far larger than digests, and only a shuffle of their prints holds them all.
    marked = rows.withColumn("text_key", F.xxhash64("text"))
    described = cut(marked.mapInArrow(describe, "doc_id long, text_key long, sig long, n long"))
    filled = described.where("n > 0")
    table, first = keys_twice(rows.select("text"), lambda batches: (keys for _, _, keys in new_keys(batches)), int(filled.agg(F.sum("n")).first()[0] or 0))
    twice_ = df.sparkSession.sparkContext.broadcast(table)
    entries = rows.mapInArrow(shared_keys_of, "sig long, key long")
    # Keys of very many sets, by a sample; their share bounds how many there can be (1 / FREQUENT).
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).mapInArrow(keys_of, "sig long, key long")
    sampled = cut(some.groupBy("key").agg(F.count("*").alias("n")))
    least = max(16.0, FREQUENT * (sampled.agg(F.sum("n")).first()[0] or 0))
    frequent = F.broadcast(sampled.where(F.col("n") >= least).select("key", F.lit(True).alias("hot")))
    salted = entries.join(frequent, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    salted = salted.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("sig", F.lit(1)), F.lit(SALTS))).otherwise(0).cast("int"))

    def tie(batches):
        """Each set of a (key, salt) to its first one, and the first ones of salted keys; rows come sorted, so one hub is kept."""
        held = None
        for batch in batches:
            key, salt, sig = (batch.column(c).to_numpy() for c in ("key", "salt", "sig"))
            hot = batch.column("hot").to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            fresh = np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
            if held is not None and held[:2] == (key[0], salt[0]):
                fresh[0] = False
            hub = sig[np.maximum.accumulate(np.where(fresh, np.arange(len(sig)), 0))]
            if not fresh[0]:
                hub[: int(np.argmax(fresh)) if fresh.any() else len(hub)] = held[2]
            held = (key[-1], salt[-1], hub[-1])
            out = (hub != sig) | (fresh & hot)
            columns = [pa.array(sig[out]), pa.array(hub[out]), pa.array(key[out], mask=~(fresh & hot)[out])]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "key"])

    tied = salted.repartition("key", "salt").sortWithinPartitions("key", "salt", "sig").mapInArrow(tie, "a long, b long, key long")
    tied = cut(tied.groupBy("a", "b", "key").agg(F.count("*").alias("agree")))
    twice_.unpersist()
    tops = tied.where("key is not null").groupBy("key").agg(F.min("a").alias("top"), F.collect_set("a").alias("hubs"))  # SALTS hubs a key at most
    edges = tied.select("a", "b").unionByName(tops.select(F.explode("hubs").alias("a"), F.col("top").alias("b")))

    coarse = contract(edges)
    rank = F.coalesce("doc_id", F.lit(2**63 - 1))
    nodes = filled.groupBy("sig").agg(F.max("n").alias("n"), F.min("doc_id").alias("id"), F.min(F.struct(rank.alias("rank"), "text_key")).alias("of"))
    members = cut(coarse.join(nodes, coarse.node == nodes.sig).select("node", "root", "of.rank", "of.text_key", "n"))

    def sets(batches):
        sent: set[int] = set()  # rows that repeat send their set once a task
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = shingles(*flat_utf8(part, "text"), k)
                same = [digest(s) == node and node not in sent and not sent.add(node) for s, node in zip(found, part.column("node").to_pylist())]
                kept = part.filter(pa.array(same, type=pa.bool_()))
                data = pa.array([s.tobytes() for s, ok in zip(found, same) if ok], type=pa.binary())
                yield pa.RecordBatch.from_arrays([kept.column("node"), kept.column("root"), data], names=["node", "root", "set"])

    # Of texts, little but the members is shuffled; sets, which are larger, are only kept once most have left.
    at = F.xxhash64("rank", "text_key")
    member = maybe_in(members.select(at.alias("at")), "at")
    texts = marked.withColumn("rank", rank).where(member(at)).join(members, ["rank", "text_key"]).select("node", "root", "text")

    def grouped_keys(batches):
        for batch in sets(batches):
            for root, data in zip(batch.column("root").to_pylist(), batch.column("set").to_pylist()):
                yield of_group(np.frombuffer(data, np.uint64), root)

    table, bits = keys_twice(texts, grouped_keys, int(members.agg(F.sum("n")).first()[0] or 0))
    twice = df.sparkSession.sparkContext.broadcast(table)

    def may_link(batches):
        for batch in sets(batches):
            ok = []
            for root, data in zip(batch.column("root").to_pylist(), batch.column("set").to_pylist()):
                keys = of_group(np.frombuffer(data, np.uint64), root)
                ok.append(100 * int(twice_in(twice.value, bits, keys).sum()) >= percent * len(keys))
            yield batch.filter(pa.array(ok, type=pa.bool_()))

    held = cut(texts.mapInArrow(may_link, "node long, root long, set binary"))
    twice.unpersist()

    def verified(batches):
        for batch in batches:
            for part in slices(batch, "set", SLICE):
                ok = []
                for own, other in zip(part.column("set").to_pylist(), part.column("other").to_pylist()):
                    x, y = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(ok, type=pa.bool_()))

    closest = tied.where("a != b").groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b"))
    pairs = closest.join(held.select(F.col("node").alias("a"), "set"), "a").join(held.select(F.col("node").alias("b"), F.col("set").alias("other")), "b")
    block = contract(pairs.select("a", "b", "set", "other").mapInArrow(verified, "a long, b long")).select("node", F.col("root").alias("block"))

    held = held.join(block, "node", "left").withColumn("block", F.coalesce("block", "node"))

    def spread(batches):
        """A row per shingle of a set; a shingle of different groups has different keys."""
        for batch in batches:
            for part in slices(batch, "set", SLICE):
                found = [np.frombuffer(x, np.uint64) for x in part.column("set").to_pylist()]
                sizes = list(map(len, found))
                salt = np.repeat(mixed(part.column("root").to_numpy().view(np.uint64)), sizes)
                columns = [(np.concatenate(found) ^ salt).view(np.int64), *(np.repeat(part.column(c).to_numpy(), sizes) for c in ("node", "block"))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "node", "block"])

    # Only groups of several blocks go on, and of those the sets that share enough with other blocks than their own.
    several = held.groupBy("root").agg((F.min("block") != F.max("block")).alias("several")).where("several").select("root")
    held = cut(held.join(several, "root").select("root", "node", "block", "set"))
    spreads = held.mapInArrow(spread, "shingle long, node long, block long")
    outside = spreads.groupBy("shingle").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo != hi").select("shingle")
    shared = spreads.join(outside, "shingle").groupBy("node").agg(F.count("*").alias("shared"))
    held = cut(held.join(shared, "node").where(F.col("shared") * 100 >= F.octet_length("set") / 8 * percent).drop("shared"))

    blocks = held.groupBy("root", "block").agg(F.sum(F.octet_length("set") / 8).alias("size"))
    groups = blocks.groupBy("root").agg(F.max_by("block", F.struct("size", "block")).alias("main"), F.max("size").alias("main_size"), F.sum("size").alias("size"), F.count("*").alias("n"))
    pieces = F.ceil(F.col("size") / GROUP_SHINGLES).cast("int")
    wide = F.col("size") - F.col("main_size") > GROUP_SHINGLES
    groups = cut(groups.where("n > 1").select("root", "main", wide.alias("wide"), F.when(pieces > 1, F.when(wide, 2 * pieces).otherwise(pieces)).otherwise(1).alias("pieces")))
    held = held.join(groups, "root").withColumn("asks", F.col("block") != F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    meets = (
        F.when(F.col("wide"), F.transform(every, lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"))))
        .when(F.col("asks"), F.transform(every, lambda j: F.struct(j.alias("i"), j.alias("j"))))
        .otherwise(F.array(F.struct(own.alias("i"), own.alias("j"))))
    )
    held = held.withColumn("meet", F.explode(meets)).select("root", F.col("meet.i").alias("i"), F.col("meet.j").alias("j"), "node", "block", "asks", "set")

    def join(batches):
        key, held_ = None, {}

        def linked():
            block_ = np.array([b for b, _, _ in held_.values()], dtype=np.int64)
            asks = np.array([a for _, a, _ in held_.values()], dtype=bool)
            if len(held_) < 2 or not asks.any():
                return None
            root = Relations([np.frombuffer(s, np.uint64) for _, _, s in held_.values()], percent, block_, asks).run()
            new = block_[root] != block_
            return pa.RecordBatch.from_arrays([pa.array(block_[new]), pa.array(block_[root[new]])], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "i", "j", "node", "block", "asks", "set")]
            for root, i, j, node, *rest in zip(*columns):
                if (root, i, j) != key:
                    if (out := linked()) is not None:
                        yield out
                    key, held_ = (root, i, j), {}
                held_[node] = rest
        if (out := linked()) is not None:
            yield out

    links = held.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node").mapInArrow(join, "a long, b long")
    found = contract(links)

    named = nodes.join(block, nodes.sig == block.node, "left").select("sig", "id", F.coalesce("block", "sig").alias("block"))
    named = named.join(found, named.block == found.node, "left").select("sig", "id", F.coalesce("root", "block").alias("root"))
    names = named.groupBy("root").agg(F.min("id").alias("component_id"))
    by_set = cut(named.join(names, "root").select(F.col("sig").alias("of"), F.col("root").alias("group"), "component_id"))
    joined = described.join(by_set, F.when(F.col("n") > 0, F.col("sig")) == F.col("of"), "left")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_key", "group"
    )


def representatives(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that name a component: one document of each group.

    Of rows that repeat such an id and text one stays; rows that share an id but not a group each stay. Rows
    without an id can't be told apart and stay.
    """
    found = cut(components(df, k, percent, id_col, text_col).select("doc_id", "component_id", "text_key", "group"))
    names = found.where("doc_id = component_id").groupBy("doc_id", "group").agg(F.min("text_key").alias("__key"))
    names = cut(names.select(F.col("doc_id").alias("__id"), "__key").distinct())
    id_, key = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))
    # Rows that may go, or repeat, are shuffled with their texts and looked up; of the others each is the one of its id and text, and stays.
    once = found.where("doc_id is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    once = once.join(names, (F.col("doc_id") == F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    in_doubt = maybe_in(cut(once.where("n > 1 or __id is null").select(F.xxhash64("doc_id", "text_key").alias("at"))), "at")(F.xxhash64(id_, key))
    named = df.where(id_.isNotNull())
    kept = named.where(in_doubt).join(names, (id_ == F.col("__id")) & (key == F.col("__key")), "left_semi")
    kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy(id_, key).orderBy(F.lit(1)))).where("__n = 1").drop("__n")
    return kept.unionByName(named.where(~in_doubt)).unionByName(df.where(id_.isNull()))
