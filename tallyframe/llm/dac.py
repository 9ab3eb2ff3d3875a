"""Token-id files with directly addressable codes.

A file is a run of segments, one after the other, each followed by one line feed. A segment holds
the ids of some documents: chunk level 0 has the low ``BITS`` bits of every id, a continuation
bitmap marks the ids with more, level 1 has the next bits of those, and so on. A rank directory
(set bits before every ``RANK`` bits) finds an id's place on the next level, so any token is read
without decoding a block (``Segment.token``).

``write_token_files`` encodes whole texts and writes them in ascending ``doc_id`` order;
``read_token_files`` gives a row per document. A null or empty text is the end id alone; a null
``doc_id`` comes first; rows with one ``doc_id`` are ordered by text, and may fill several parts; an empty
table gives no file with rows; other columns of the frame are not looked at. Segments are bytes that Spark's
text writer stores as they are (a cast to string checks nothing).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm._common import cut, id_and_text, slices, strings
from tallyframe.llm.bpe import encoder, load

MAGIC, BITS, RANK = b"DAC1", 8, 512
#: magic, bytes of the segment, part, tokens of the part before, documents, tokens, levels.
HEADER = struct.Struct("<4sQQQQQI")


def pack_segment(part: int, before: int, doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of a segment; ``known`` is false where a document's id is null."""
    body = [doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), counts.astype("<i8").tobytes()]
    rest, levels = ids.astype(np.uint64), 0
    while len(rest):
        more = (rest >> np.uint64(BITS)) > 0
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.r_[bitmap, np.zeros(-len(bitmap) % (RANK // 8), dtype=np.uint8)]
        ones = np.bitwise_count(bitmap).reshape(-1, RANK // 8).sum(axis=1, dtype=np.uint64)
        ranks = np.cumsum(ones) - ones
        body += [struct.pack("<Q", len(rest)), (rest & np.uint64(2**BITS - 1)).astype(np.uint8).tobytes(), bitmap.tobytes(), ranks.astype("<u4").tobytes()]
        rest, levels = rest[more] >> np.uint64(BITS), levels + 1
    data = b"".join(body)
    return HEADER.pack(MAGIC, HEADER.size + len(data), part, before, len(doc_ids), len(ids), levels) + data


class Segment:
    """A segment in memory; arrays are views of the file's bytes."""

    def __init__(self, data: memoryview):
        magic, self.size, self.part, self.before, n, self.tokens, levels = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        self.doc_ids, at = np.frombuffer(data, "<i8", n, at), at + 8 * n
        self.known, at = np.frombuffer(data, np.uint8, n, at), at + n
        self.counts, at = np.frombuffer(data, "<i8", n, at), at + 8 * n
        self.levels = []
        for _ in range(levels):
            (size,), at = struct.unpack_from("<Q", data, at), at + 8
            chunk, at = np.frombuffer(data, np.uint8, size, at), at + size
            blocks = -(-size // RANK)
            bitmap, at = np.frombuffer(data, np.uint8, blocks * RANK // 8, at), at + blocks * RANK // 8
            ranks, at = np.frombuffer(data, "<u4", blocks, at), at + 4 * blocks
            self.levels.append((chunk, bitmap, ranks))

    def token(self, i: int) -> int:
        """The id at place ``i``, without decoding others."""
        value = shift = 0
        for chunk, bitmap, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK
            inside = bitmap[block * RANK // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(inside).sum()) + int(bitmap[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += BITS
        return value

    def ids(self) -> np.ndarray:
        """All ids, as uint32."""
        out = np.zeros(self.tokens, dtype=np.uint32)
        at: np.ndarray | slice = slice(None)
        for level, (chunk, bitmap, _) in enumerate(self.levels):
            out[at] |= chunk.astype(np.uint32) << np.uint32(BITS * level)
            more = np.flatnonzero(np.unpackbits(bitmap, count=len(chunk), bitorder="little"))
            at = more if level == 0 else at[more]
        return out


def write_token_files(
    df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    segment_tokens: int = 1 << 19, segments_per_file: int = 8,
) -> None:
    """Encode whole texts, end each with ``end_id`` and write them in ascending ``doc_id`` order.

    Parts are ranges of ``doc_id``; within a part rows are sorted by ``doc_id`` and text. The files
    are written by Spark, so ``path`` may be in any store that Spark writes.
    """
    content = df.sparkSession.sparkContext.broadcast(load(tokenizer_path))

    def run(batches):
        tool, part, before = encoder(content.value), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def packed():
            nonlocal before, held, size
            segment = pack_segment(part, before, *(np.concatenate([h[i] for h in held]) for i in range(4)))
            before, held, size = before + size, [], 0
            return pa.RecordBatch.from_arrays([pa.array([segment], type=pa.binary())], names=["segment"])

        for batch in batches:
            for rows in slices(batch, "text", 1 << 20):
                ids, counts = tool.encode(strings(rows, "text"))
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id))
                docs = rows.column("doc_id")
                held.append((docs.fill_null(0).to_numpy(zero_copy_only=False), docs.is_valid().to_numpy(zero_copy_only=False), counts + 1, ids))
                size += len(ids)
                if size >= segment_tokens:
                    yield packed()
        if held:
            yield packed()

    # The start of the text deals rows that share an id, in the order of texts.
    rows = id_and_text(df, id_col, text_col).repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    files = rows.mapInArrow(run, "segment binary").select(F.col("segment").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", segments_per_file).text(path)


def segments(content: bytes):
    """The segments of a file."""
    view, at = memoryview(content), 0
    while at < len(view):
        segment = Segment(view[at:])
        yield segment
        at += segment.size + 1


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it. What the driver gathers is one sum a part.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                for s in segments(content.as_buffer()):
                    ids = s.ids()
                    ends = np.cumsum(s.counts)
                    sums = [zlib.crc32(ids[e - c : e].astype("<u4").tobytes()) for e, c in zip(ends.tolist(), s.counts.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(s.doc_ids, mask=s.known == 0),
                            pa.array(np.full(len(ends), s.part, dtype=np.int64)),
                            pa.array(s.before + ends - s.counts),
                            pa.array(s.counts),
                            pa.array(np.array(sums, dtype=np.int64)),
                        ],
                        names=["doc_id", "part", "at", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    docs = cut(files.mapInArrow(run, "doc_id long, part long, at long, n_tokens long, ids_crc32 long"))
    sums = docs.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases, base = [], 0
    for r in sums:
        bases.append((r.part, base))
        base += r.n
    before = spark.createDataFrame(bases, "part long, base long")  # one row a part of the files
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
