"""Web archives: WARC writing, reading, and assembly of captures.

Each page becomes three records: request, response (or revisit, if another page's response has the
same payload) and metadata, tied together by ``WARC-Concurrent-To``. Every record is a gzip member of its own, so that a reader may seek it. Tasks join
members to files of ``file_bytes`` at most (or one page, if that is larger), and Spark's own text writer stores
them, so they may lie in any store that Spark writes. ``read_archives`` gives a row per record; ``assemble``
joins records into one nested row per capture.

Of the pages with equal payloads (by SHA-256) the one with the largest ``page_id`` is the response
and the others revisit it. A null html is an empty payload; a null ``page_id`` revisits the group's
largest, or is a response if there is none; a null url has no target header. Rows that repeat both
``page_id`` and payload share a capture id and are counted in ``copies``. A very long html is held whole by
its task, twice over, like any page; an empty table gives no record; other columns of the frame are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm._common import cut

EOL = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, digest_ok boolean, page_id long, payload_length long, payload binary"
)


def base32_sha1(binary: Column) -> Column:
    """The bare upper-case base32 of the SHA-1 of a binary column, which is always 32 characters."""
    digits = F.sha1(binary)
    parts = [F.lpad(F.conv(F.substring(digits, at, size), 16, 32), size * 4 // 5, "0") for at, size in ((1, 15), (16, 15), (31, 10))]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column, media: str, date: str) -> Column:
    lines = [F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(f"{EOL}WARC-Record-ID: <"), record_id]
    lines.append(F.lit(f">{EOL}WARC-Date: {date}{EOL}"))
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit("")))
    lines += [F.lit(f"Content-Type: {media}{EOL}Content-Length: "), F.octet_length(block).cast("string"), F.lit(EOL + EOL), block]
    return F.concat(*lines)


def write_archives(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    file_bytes: int = 32 << 20, date: str = "2000-01-01T00:00:00Z", compress: bool = True,
) -> None:
    """Write each page's records, in files bounded by bytes.

    Pages meet the group of their payload by id and digest, so that a payload of very many pages moves as ids
    alone; no html goes by the digest only.
    """
    pages = df.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20]", "%20").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("key", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    groups = pages.groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    shared = cut(pages.select("page_id", "key").distinct().join(groups.select("key", "last"), "key")).alias("shared")
    same = F.col("pages.page_id").eqNullSafe(F.col("shared.page_id")) & (F.col("pages.key") == F.col("shared.key"))
    rows = pages.alias("pages").join(shared, same, "left").select("pages.*", "shared.last")

    digest = base32_sha1(F.col("html").cast("binary"))
    text_id = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    rows = rows.select("page_id", "url", "html", "last", revisit.alias("revisit"), digest.alias("digest"), text_id.alias("tid"))
    capture = F.concat(F.lit("urn:capture:"), "tid", F.lit(":"), "digest")
    concurrent = F.concat(F.lit("<"), capture, F.lit(">"))
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    target = F.regexp_extract("url", r"://[^/?#]*([^#]*)", 1)
    request = _record(
        "request", F.concat(capture, F.lit(":request")), [("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", concurrent)],
        F.concat(F.lit("GET "), F.coalesce(F.when(target != "", target), F.lit("/")), F.lit(f" HTTP/1.1{EOL}Host: "), F.coalesce(host, F.lit("")), F.lit(EOL + EOL)),
        "application/http;msgtype=request", date,
    )
    main = _record(
        F.when(F.col("revisit"), "revisit").otherwise("response"), capture,
        [
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(F.col("revisit"), F.concat(F.lit("<urn:capture:"), F.col("last").cast("string"), F.lit(":"), "digest", F.lit(">")))),
        ],
        F.concat(F.lit(_HTTP), F.when(F.col("revisit"), "").otherwise(F.col("html"))), "application/http;msgtype=response", date,
    )
    metadata = _record(
        "metadata", F.concat(capture, F.lit(":metadata")), [("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", concurrent)],
        F.concat(
            F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(EOL)), F.lit("")),
            F.lit("payload-length: "), F.octet_length("html").cast("string"), F.lit(EOL),
        ),
        "application/warc-fields", date,
    )
    end = F.lit(EOL + EOL)
    parts = rows.select(*(F.concat(x, end).alias(n) for n, x in (("request", request), ("main", main), ("metadata", metadata))))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*batch.columns):
                page = b"".join(_member(x.as_py().encode(), compress) for x in row)
                if held and size + len(page) > file_bytes:
                    yield _file(held)
                    held, size = [], 0
                held.append(page)
                size += len(page)
        if held:
            yield _file(held)

    files = parts.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", "\0" if compress else "\n").option("maxRecordsPerFile", 1).text(path)


def _member(record: bytes, compress: bool) -> bytes:
    return zlib.compress(record, 6, wbits=31) if compress else record


def _file(pages: list[bytes]) -> pa.RecordBatch:
    """One file, but for its last byte, which the text writer's row separator adds.

    A file ends with a metadata record, whose line feed, or the highest byte of whose length in its gzip member, 0, is that byte.
    """
    return pa.RecordBatch.from_arrays([pa.array([b"".join(pages)[:-1]], type=pa.binary())], names=["file"])


def records(content: bytes, with_payload: bool):
    """The records of one archive, as tuples in the order of ``RECORD``; one record is in memory at a time."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record here: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        kind = head["warc-type"]
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        size = ok = page = length = payload = None
        if kind in ("response", "revisit"):
            body = block.partition(b"\r\n\r\n")[2]
            if kind == "response":
                found = base64.b32encode(hashlib.sha1(body).digest()).decode()
                size, ok, digest, payload = len(body), found == digest, found, body if with_payload else None
        elif kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode().split(EOL) if ": " in x)
            page, length = (int(fields[k]) if k in fields else None for k in ("page-id", "payload-length"))
        bare = lambda name: head[name].strip("<>") if name in head else None
        yield (
            bare("warc-record-id"), kind, bare("warc-concurrent-to"), bare("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"),
            digest, size, ok, page, length, payload,
        )


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives at ``path`` (columns of ``RECORD``)."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, RECORD.split(", "))])

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for r in records(content.as_py(), with_payload):
                    held.append(r)
                    size += 1000 + len(r[-1] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in held], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in held], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, copies, request, response, metadata``.

    A request or metadata record joins the response or revisit that it is concurrent to. The three
    meet in one shuffle on that identifier; a capture whose other records are missing has nulls there.
    """
    main = F.col("type").isin("response", "revisit")
    common = ["record_id", "target_uri", "date"]
    one = lambda when, *columns: F.max(F.when(when, F.struct(*common, *columns)))
    return (
        found.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id"))
        .agg(
            F.count(F.when(main, 1)).alias("copies"),
            one(F.col("type") == "request").alias("request"),
            one(main, "type", "refers_to", "payload_digest", "payload_bytes", "digest_ok", "payload").alias("response"),
            one(F.col("type") == "metadata", "page_id", "payload_length").alias("metadata"),
        )
    )


def referred_page(refers_to: Column) -> Column:
    """The page id in a record id of ``write_archives``."""
    return F.regexp_extract(refers_to, r"^urn:capture:(-?[0-9]+):", 1).try_cast("long")
