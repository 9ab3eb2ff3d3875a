"""Lexical retrieval packing: documents into token sequences, neighbours by BM25 together.

1. Whole texts become token ids (a written table). Document frequencies of all tokens are counted over
   all documents; the vocabulary bounds them.
2. Documents are ordered by content: by their leading terms, those first that they hold most in excess of
   the table. A range of that order is a task, and stretches of about ``SHARD_TOKENS`` ids in it are the
   shards of the index, so texts that share their leading terms share a shard: where the first one has
   too much text the next ones decide. Copies lie next to each other.
3. Each shard has an inverted index with BM25 weights of the whole table. The first document not used yet
   is the seed of a window; its unused neighbours, best first, fill the window greedily. The document
   that meets the window's end is cut there and goes on in the next window, so windows are full.
4. A shard's last ids, fewer than a window, are cut into sequences whose sizes are powers of two, which
   need no padding.

A null or empty text is the end id alone. Null ids and repeated rows are packed each; an empty table gives
no piece; other columns of the frame are not looked at. No id is dropped. A task holds one shard, or one
longer document. Work grows with the table: a seed meets one shard, never all. What that costs in
neighbours against one index over the whole table is stated in the README.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._common import id_and_text, scratch, slices, strings
from tallyframe.llm.bpe import encoder, load

#: Ids of a sequence; ids of a shard, about; BM25's two parameters.
WINDOW, SHARD_TOKENS, K1, B = 4096, 1 << 20, 1.2, 0.75
#: Leading terms that order the documents; most tasks that the order is dealt to (each works through its shards one by one).
LEADS, MOST_TASKS = 8, 20_000


def tokenize(df: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str, text_col: str) -> DataFrame:
    """Write and reread a row per document: ``doc_id, n`` long, ``ids`` binary (little-endian uint32 or, if they fit, uint16)."""
    content = df.sparkSession.sparkContext.broadcast(load(tokenizer_path))

    def run(batches):
        tool = encoder(content.value)
        kind = "<u2" if len(tool.names) <= 1 << 16 else "<u4"
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, counts = tool.encode(strings(part, "text"))
                ends = np.cumsum(counts)
                data = [np.append(ids[e - c : e], end_id).astype(kind).tobytes() for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts + 1), pa.array(data, type=pa.binary())], names=["doc_id", "n", "ids"])

    id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n long, ids binary").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def flat_ids(part: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch end to end, and the ``rows + 1`` offsets of its documents."""
    values = part.column("ids").cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def postings(flat: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens of each document: document, token, count, in the order of documents and tokens."""
    key = np.sort(np.repeat(np.arange(len(offsets) - 1) * size, np.diff(offsets)) + flat)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
    return key[first] // size, key[first] % size, np.diff(np.r_[first, len(key)])


def document_frequencies(docs: DataFrame, kind: str, size: int) -> np.ndarray:
    """How many documents hold each token. A task sends a row per token at most, the driver gets as many."""

    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "ids"):
                total += np.bincount(postings(*flat_ids(part, kind), size)[1], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["token", "n"])

    out = np.zeros(size, dtype=np.int64)
    sums = docs.select("ids").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    for r in sums.collect():
        out[r.token] = r.n
    return out


def bm25(doc: np.ndarray, token: np.ndarray, count: np.ndarray, sizes: np.ndarray, weight: np.ndarray, mean: float) -> np.ndarray:
    """The BM25 weight of each posting; ``weight``: a token's inverse document frequency; ``mean``: the documents' mean length."""
    return weight[token] * count * (K1 + 1) / (count + K1 * (1 - B + B * sizes[doc] / mean))


def leads(flat: np.ndarray, offsets: np.ndarray, frequency: np.ndarray) -> list[bytes]:
    """Each document's leading terms, as a string of bytes in whose order documents that share them come together.

    A term leads by its count times the logarithm of that count over what the table's frequencies let one expect.
    """
    doc, token, count = postings(flat, offsets, len(frequency))
    expected = np.diff(offsets)[doc] * np.maximum(frequency[token], 1) / max(1, frequency.sum())
    order = np.lexsort((token, -count * np.log(count / expected), doc))
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    token = token[order][place < LEADS].astype(">u4" if len(frequency) > 1 << 16 else ">u2")
    ends = np.cumsum(np.minimum(np.bincount(doc, minlength=len(offsets) - 1), LEADS)).tolist()
    return [token[a:b].tobytes() for a, b in zip([0, *ends], ends)]


class Index:
    """The BM25 inverted index of one shard; documents that are used leave it."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray, weight: np.ndarray, mean: float):
        doc, token, count = postings(flat, offsets, len(weight))
        self.own = np.searchsorted(doc, np.arange(len(offsets)))
        order = np.argsort(token, kind="stable")
        names, first = np.unique(token[order], return_index=True)
        self.term = np.searchsorted(names, token)
        self.start = np.r_[first, len(order)]
        self.doc, self.score = doc[order], bm25(doc, token, count, np.diff(offsets), weight, mean)[order]
        self.n, self.used, self.left = len(offsets) - 1, np.zeros(len(offsets) - 1, dtype=bool), len(offsets) - 1
        self.listed = self.left

    def use(self, doc: int) -> None:
        self.used[doc] = True
        self.left -= 1
        if self.left < 0.7 * self.listed:
            keep = ~self.used[self.doc]
            self.start = np.r_[0, np.cumsum(keep)][self.start]
            self.doc, self.score, self.listed = self.doc[keep], self.score[keep], self.left

    def neighbours(self, seed: int):
        """Unused documents that share a term with the seed, best first; ties to the earlier one."""
        terms = self.term[self.own[seed] : self.own[seed + 1]]
        first, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        total = np.bincount(self.doc[at], weights=self.score[at], minlength=self.n)
        total[self.used] = 0
        # Few are wanted as a rule: the best first, the others only when asked for.
        few = np.partition(total, -32)[-32] if self.n > 32 else 0
        for found in (np.flatnonzero(total >= max(few, 1e-300)), np.flatnonzero((total < few) & (total > 0))):
            yield from found[np.argsort(-total[found], kind="stable")].tolist()


def order_documents(flat: np.ndarray, offsets: np.ndarray, weight: np.ndarray, mean: float) -> list[int]:
    """The documents of a shard in the order in which they fill its windows."""
    index, sizes = Index(flat, offsets, weight, mean), np.diff(offsets).tolist()
    out: list[int] = []
    filled = 0
    for seed in range(len(sizes)):
        if index.used[seed]:
            continue
        index.use(seed)
        out.append(seed)
        filled += sizes[seed]
        room = -filled % WINDOW
        if room and index.left:
            for other in index.neighbours(seed):
                index.use(other)
                out.append(other)
                filled += sizes[other]
                room -= sizes[other]
                if room <= 0:
                    break
    return out


def pieces(order: list[int], sizes: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece when documents are laid end to end into sequences."""
    total = sum(sizes)
    full = total // window
    rest = total - full * window
    bounds = [window] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    out, sequence, offset = [], 0, 0
    for doc in order:
        start = 0
        while start < sizes[doc]:
            length = min(sizes[doc] - start, bounds[sequence] - offset)
            out.append((doc, start, length, sequence, offset))
            start += length
            offset += length
            if offset == bounds[sequence]:
                sequence, offset = sequence + 1, 0
    return out


def pack_documents(
    df: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset`` long and ``ids`` binary (little-endian uint32)."""
    spark = df.sparkSession
    docs = tokenize(df, tokenizer_path, end_id, scratch(spark, "packing-ids"), id_col, text_col)
    vocabulary = len(encoder(load(tokenizer_path)).names)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    found = docs.agg(F.count("*").alias("docs"), F.sum("n").alias("n")).first()
    count, total = found.docs, found.n or 0
    mean = total / max(1, count)
    frequency = document_frequencies(docs, kind, vocabulary)
    weight = spark.sparkContext.broadcast(np.log1p((count - frequency + 0.5) / (frequency + 0.5)))
    counted = spark.sparkContext.broadcast(frequency)

    def lead(batches):
        for batch in batches:
            for part in slices(batch, "ids"):
                found = pa.array(leads(*flat_ids(part, kind), counted.value), type=pa.binary())
                yield pa.RecordBatch.from_arrays([found, *(part.column(c) for c in ("row", "doc_id", "ids"))], names=["lead", "row", "doc_id", "ids"])

    # The row's number deals rows that are alike in all else; the written table fixes it.
    led = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids").mapInArrow(lead, "lead binary, row long, doc_id long, ids binary")
    order = ["lead", "doc_id", "row"]
    ranged = led.repartitionByRange(max(1, min(-(-total // shard_tokens), MOST_TASKS)), *order).sortWithinPartitions(*order)

    def pack(batches):
        base, held, size = TaskContext.get().partitionId() << 32, [], 0

        def packed():
            nonlocal base, held, size
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            flat, offsets = flat_ids(part, kind)
            sizes, names = np.diff(offsets).tolist(), part.column("doc_id").to_pylist()
            at = offsets.tolist()
            doc, start, length, sequence, offset = zip(*pieces(order_documents(flat, offsets, weight.value, mean), sizes))
            columns = [[names[d] for d in doc], start, length, [sizes[d] for d in doc], [base + s for s in sequence], offset]
            data = [flat[at[d] + s : at[d] + s + n].astype("<u4").tobytes() for d, s, n in zip(doc, start, length)]
            base, held, size = base + sequence[-1] + 1, [], 0
            arrays = [*(pa.array(c, type=pa.int64()) for c in columns), pa.array(data, type=pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            ends = np.cumsum(np.diff(flat_ids(batch, kind)[1])) if batch.num_rows else np.empty(0, dtype=np.int64)
            first = done = 0
            while first < batch.num_rows:
                last = max(first + (not held), int(np.searchsorted(ends, done + shard_tokens - size, side="right")))
                held.append(batch.slice(first, last - first))
                size, first, done = size + int(ends[last - 1] if last else 0) - done, last, int(ends[last - 1] if last else 0)
                if first < batch.num_rows:
                    yield packed()
        if held:
            yield packed()

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return ranged.select("doc_id", "ids").mapInArrow(pack, schema)
