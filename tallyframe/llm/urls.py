"""URL filters over a sorted digest array.

A list of entries (``host/path-prefix`` or ``host``) is a row of files that Spark builds: the entries' 64-bit
xxhash keys in ascending ranges, a file a range: sorted keys, then the offsets and the strings. ``addFile``
hands the files to the executors from the shared folder; a task memory-maps them, probes many candidate
strings at once by binary search, and confirms each hit against the stored string, so that colliding keys
can't decide.

An entry fits its host and all subdomains if the url's path starts with the entry's. Its candidates for a
url are thus the host and its parent domains, and for those that the list marks as having paths, the path
cut to the lengths that occur in the list. The longest fitting rule decides; without one, a url on the
block list is blocked. The list is a frame, of any source; ``flagged_hosts`` derives one from a table of pages.

A null url, or one without ``://``, has an empty host and path and fits nothing. Repeated rows are judged
each; an empty list or table gives no hit or no row; very long urls are no special case; other columns of the
frame are not looked at.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._common import scratch

MAGIC = b"SDA2"
#: The rules that come before any list; host and path start, and what they say.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Words of a host's labels that put it on the derived block list.
FLAGGED_WORDS = ("ads", "adult", "bets", "casino", "malware", "phishing", "pills", "poker", "porn", "sex", "spam", "viagra", "warez", "xxx")
#: Entries of a file, about; Spark's seed of xxhash64.
FILE_ENTRIES, SEED = 1 << 22, 42
_SPLIT = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = {i: i + 32 for i in range(65, 91)}


def keys(values: list[str]) -> np.ndarray:
    """The keys of strings, equal to Spark's ``xxhash64``."""
    return np.fromiter((xxhash.xxh64_intdigest(v, SEED) for v in values), dtype=np.uint64, count=len(values)).view(np.int64)


def packed(sorted_keys: np.ndarray, texts: list[bytes]) -> bytes:
    """The bytes of a file: magic, size, sorted keys, offsets and UTF-8 strings."""
    head = struct.pack("<4sQ", MAGIC, len(texts)) + bytes(4)
    return b"".join([head, sorted_keys.astype("<i8").tobytes(), np.cumsum([0, *map(len, texts)], dtype="<u8").tobytes(), *texts])


def packed_list(entries: list[str]) -> bytes:
    """A short list as one file's bytes."""
    found = sorted(zip(keys(entries).tolist(), (e.encode() for e in entries)))
    return packed(np.array([k for k, _ in found], dtype=np.int64), [t for _, t in found])


def marked(entries: list[str]) -> list[str]:
    """The entries and, for each host that has paths, a mark."""
    return sorted({*entries, *(e.partition("/")[0] + "\0" for e in entries if "/" in e)})


def write_digests(entries: DataFrame, path: str, file_entries: int = FILE_ENTRIES) -> tuple[list[str], list[int]]:
    """Write the files of a list, the frame's first column; their paths and the path lengths that occur."""
    entry = F.col(entries.columns[0]).cast("string")
    rows = entries.select(entry.alias("entry")).where("entry is not null")
    rows = rows.select(F.explode(F.when(F.contains("entry", F.lit("/")), F.array("entry", F.concat(F.split_part("entry", F.lit("/"), F.lit(1)), F.lit("\0")))).otherwise(F.array("entry"))).alias("entry"))
    rows = rows.distinct().withColumn("key", F.xxhash64("entry"))
    path_size = F.when(F.contains("entry", F.lit("/")), F.length("entry") - F.instr("entry", "/") + 1).otherwise(0)
    n, lengths = rows.agg(F.count("*"), F.collect_set(path_size)).first()  # no more lengths than a url has

    def run(batches):
        found = list(batches)  # file_entries rows, about
        if sum(b.num_rows for b in found):
            t = pa.Table.from_batches(found)
            yield pa.RecordBatch.from_arrays([pa.array([packed(t.column("key").to_numpy(), [e.encode() for e in t.column("entry").to_pylist()])], type=pa.binary())], names=["data"])

    ranged = rows.repartitionByRange(max(1, -(-n // file_entries)), "key").sortWithinPartitions("key", "entry")
    ranged.mapInArrow(run, "data binary").select(F.col("data").cast("string").alias("value")).write.text(path)
    written = entries.sparkSession.read.format("binaryFile").load(path).where("length > 0").select("path").collect()  # a row a file
    return sorted(r.path for r in written), sorted(lengths)


class DigestArray:
    """Files of a list as one sorted array; ``parts`` are bytes or memory maps."""

    def __init__(self, parts: list):
        self.parts = []
        for data in parts:
            data = np.frombuffer(data, dtype=np.uint8) if isinstance(data, bytes) else data
            magic, n = struct.unpack("<4sQ", data[:12].tobytes())
            if magic != MAGIC:
                raise ValueError("not a digest array")
            if n:
                self.parts.append((data[16 : 16 + 8 * n].view("<i8"), data[16 + 8 * n : 24 + 16 * n].view("<u8"), data[24 + 16 * n :]))
        self.parts.sort(key=lambda p: int(p[0][0]))
        self.first = np.array([p[0][0] for p in self.parts], dtype=np.int64)

    def contains(self, candidates: list[str]) -> np.ndarray:
        """Whether each candidate is in the list: binary search, then a look at the stored strings."""
        hashed, found = keys(candidates), np.zeros(len(candidates), dtype=bool)
        owner = np.searchsorted(self.first, hashed, side="right") - 1
        for part in np.unique(owner[owner >= 0]).tolist():
            stored, offsets, texts = self.parts[part]
            mine = np.flatnonzero(owner == part)
            at = np.searchsorted(stored, hashed[mine])
            hit = stored[np.minimum(at, len(stored) - 1)] == hashed[mine]
            for i, k in zip(mine[hit].tolist(), at[hit].tolist()):
                while k < len(stored) and stored[k] == hashed[i] and not found[i]:
                    found[i] = texts[int(offsets[k]) : int(offsets[k + 1])].tobytes() == candidates[i].encode()
                    k += 1
        return found


def host_and_path(url: str | None) -> tuple[str, str]:
    m = _SPLIT.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def longest(array: DigestArray, lengths: list[int], hosts: list[str], paths: list[str]) -> list[str | None]:
    """The longest entry of the list that fits each url."""
    domains: dict[str, list[str]] = {}
    for host in set(hosts):
        labels = host.split(".") if host else []
        domains[host] = [".".join(labels[k:]) for k in range(len(labels))]
    every = sorted(set().union(*domains.values())) if domains else []
    has_paths = dict(zip(every, array.contains([d + "\0" for d in every]).tolist())) if any(lengths) else {}
    index: dict[str, int] = {}
    tries = []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        for domain in domains[host]:
            for n in lengths if has_paths.get(domain) else lengths[:1] if lengths and not lengths[0] else []:
                if n <= len(path):
                    tries.append((i, index.setdefault(domain + path[:n], len(index))))
    names, best = list(index), [None] * len(hosts)
    held = array.contains(names).tolist()
    for i, k in tries:
        if held[k] and (best[i] is None or len(names[k]) > len(best[i])):
            best[i] = names[k]
    return best


def host_of(url: Column) -> Column:
    """A url's host, as ``host_and_path`` has it."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def flagged_hosts(df: DataFrame, words: tuple[str, ...] = FLAGGED_WORDS, url_col: str = "url") -> DataFrame:
    """A block list from all urls of a table: ``entry``, each domain whose first label has one of ``words`` between its dashes."""
    hosts = df.select(host_of(F.col(url_col).cast("string")).alias("host")).distinct()
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.slice(labels, k, F.size(labels)))
    flagged = F.filter(domains, lambda d: F.arrays_overlap(F.split(d[0], "-"), F.array(*map(F.lit, words))))
    return hosts.select(F.explode(flagged).alias("d")).select(F.array_join("d", ".").alias("entry")).distinct()


_arrays: dict[tuple[str, ...], DigestArray] = {}


def _open(names: tuple[str, ...]) -> DigestArray:
    if names not in _arrays:
        _arrays.clear()
        _arrays[names] = DigestArray([np.memmap(SparkFiles.get(n), dtype=np.uint8, mode="r") for n in names])
    return _arrays[names]


def judge_urls(df: DataFrame, blocked: DataFrame, rules: dict[str, str] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: ``page_id, host, path, rule, listed, verdict``. ``blocked``: a frame whose first column holds the entries of the block list."""
    spark = df.sparkSession
    files, lengths = write_digests(blocked, scratch(spark, "digests"))
    for f in files:
        spark.sparkContext.addFile(f)
    names = tuple(f.rsplit("/", 1)[1] for f in files)
    few, few_lengths = packed_list(marked(list(rules))), sorted({len(e) - len(e.partition("/")[0]) for e in rules})

    def run(batches):
        by_rule, by_list = DigestArray([few]), _open(names)
        for batch in batches:
            split = [host_and_path(u) for u in batch.column("url").to_pylist()]
            hosts, paths = [h for h, _ in split], [p for _, p in split]
            rule = longest(by_rule, few_lengths, hosts, paths)
            listed = longest(by_list, lengths, hosts, paths)
            verdict = [rules[r] if r is not None else "block" if b is not None else "allow" for r, b in zip(rule, listed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *(pa.array(x, type=pa.string()) for x in (hosts, paths, rule, listed, verdict))],
                names=["page_id", "host", "path", "rule", "listed", "verdict"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, listed string, verdict string")
