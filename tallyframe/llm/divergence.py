"""Source divergence audit: how far the sources of a language differ in their words, and by which words.

Arrow's compute functions do the counting inside ``mapInArrow``: ``ascii_lower`` and ``split_pattern_regex`` make a
batch's terms, ``dictionary_encode`` numbers them, and hash ``group_by`` counts them by row and then by (language,
source). A task's partial counts are merged while they are few and given on when they are many. Spark sums them by
term, and terms in too few documents of their language go. What is left is dealt, by a hash of the term, to shards
of about ``SHARD`` terms of a language; each shard holds its counts as a matrix of terms and sources, and adds its
part of every pair's divergence and its best terms of every source. Spark sums and ranks those.

All arithmetic is in whole numbers. A source's probability of a term is ``1 + floor(UNIT * (count + SMOOTH) / (n +
SMOOTH * V))`` with ``n`` its occurrences of kept terms and V the language's kept terms, a language's likewise; two
probabilities differ by ``floor((p - q)^2 / (p + q))``.

Null texts, languages and sources count as empty ones, which are values like others. Whole texts are read, however long;
rows that repeat are documents each. A source without terms takes part with counts of 0; a language without kept terms
gives its pairs a value of 0, and a source that is alone in its language gives no pair. An empty table gives no row; other
columns of the frame are not looked at. Equal values are ranked by the item's UTF-8 bytes. Counts up to 9 * 10^15 are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm._common import scratch, slices

#: What lies between terms: all of ASCII but its letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: The whole that probabilities are parts of, and what is added to each count.
UNIT, SMOOTH = 1_000_000_000, 2
#: Text bytes that are counted at once; partial counts that a task holds; kept terms of a shard, about; cells of a matrix.
PIECE, HELD, SHARD, CELLS = 8 << 20, 1 << 19, 1 << 13, 1 << 21

_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _grouped(key: np.ndarray, **sums: np.ndarray) -> pa.Table:
    """Hash-grouped counts of a key, with the sums of other columns."""
    found = pa.table({"key": key, **sums}).group_by("key", use_threads=False)
    return found.aggregate([([], "count_all"), *((c, "sum") for c in sums)])


def term_counts(part: pa.RecordBatch) -> pa.Table:
    """``lang, source, term, n, docs`` of a batch of ``lang, source, text``."""
    lists = pc.split_pattern_regex(pc.ascii_lower(part.column("text")), pattern=BETWEEN)
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy()
    rows = pc.list_parent_indices(lists).to_numpy()
    if len(words) == 0:
        return _PARTIAL.empty_table()
    empty = pc.index(words, "").as_py()  # before a first and after a last separator
    if empty >= 0:
        some = codes != empty
        codes, rows = codes[some], rows[some]
    by_row = _grouped(rows.astype(np.int64) * len(words) + codes)
    key, n = by_row["key"].to_numpy(), by_row["count_all"].to_numpy()
    langs, sources = (part.column(c).dictionary_encode() for c in ("lang", "source"))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    found = _grouped(group[key // len(words)] * len(words) + key % len(words), n=n)
    key, docs = found["key"].to_numpy(), found["count_all"]
    group, word = np.divmod(key, len(words))
    lang, source = np.divmod(group, len(sources.dictionary))
    columns = [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), words.take(pa.array(word)), found["n_sum"], docs]
    return pa.table(columns, schema=_PARTIAL)


def partial_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: each task's counts of the terms of whole texts; a key may come from many tasks."""

    def merged(tables: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return found.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_PARTIAL.names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                held.append(term_counts(part))
                size += held[-1].num_rows
                if size > HELD:
                    held = [merged(held)]
                    size = held[0].num_rows
                    if size > HELD // 2:
                        yield from held[0].to_batches(1 << 16)
                        held, size = [], 0
        if held:
            yield from merged(held).to_batches(1 << 16)

    plain = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(plain(lang, "lang"), plain(source, "source"), plain(text, "text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def probability(counts: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + SMOOTH) / (total + SMOOTH * kept)), by three divisions that stay within 64 bits."""
    below = np.asarray(total, dtype=np.int64) + SMOOTH * kept
    rest, out = counts.astype(np.int64) + SMOOTH, np.ones(np.broadcast_shapes(counts.shape, below.shape), dtype=np.int64)
    whole, rest = np.divmod(rest, below)
    out += whole * UNIT
    for place in (UNIT // 1000, UNIT // 1000**2, 1):
        whole, rest = np.divmod(rest * 1000, below)
        out += whole * place
    return out


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shard_sums(terms: pa.Table, groups: pa.Table, ranks: int) -> pa.Table:
    """A shard's part of the divergence of each pair of sources, and its ``ranks`` best terms of each source.

    ``terms``: ``lang, term, held`` (source and n of each source that holds the term); ``groups``: all sources of the
    language with their ``n`` and the language's ``kept`` and ``lang_n``. A pair is given once, smaller name first.
    """
    groups = groups.sort_by("source")
    names, total = groups["source"].combine_chunks(), groups["n"].to_numpy()
    if not len(names):
        return _SUMS.empty_table()
    lang, kept, lang_n = groups["lang"][0].as_py(), groups["kept"][0].as_py(), groups["lang_n"][0].as_py()
    s, sums, best = len(names), np.zeros((len(names), len(names)), dtype=np.int64), []
    step = max(1, CELLS // s)
    for start in range(0, terms.num_rows, step):
        part = terms.slice(start, step)
        held = part["held"].combine_chunks()
        flat, at = held.flatten(), pc.list_parent_indices(held).to_numpy()
        counts = np.zeros((part.num_rows, s), dtype=np.int64)
        counts[at, pc.index_in(flat.field("source"), value_set=names).to_numpy()] = flat.field("n").to_numpy()
        p, q = probability(counts, total[None, :], kept), probability(counts.sum(axis=1), lang_n, kept)
        for i in range(s - 1):
            sums[i, i + 1 :] += difference(p[:, i : i + 1], p[:, i + 1 :]).sum(axis=0)
        value = np.where((counts > 0) & (p > q[:, None]), difference(p, q[:, None]), -1)
        words = part["term"].to_pylist()
        for i in range(s):
            mine = value[:, i]
            least = max(0, int(np.partition(mine, -ranks)[-ranks])) if len(mine) > ranks else 0
            found = [(-int(mine[k]), words[k].encode()) for k in np.flatnonzero(mine >= least)]
            best += [(i, word.decode(), -v) for v, word in sorted(found)[:ranks]]
    a, b = np.triu_indices(s, 1)
    pairs = [pa.repeat(lang, len(a)), names.take(pa.array(a)), pa.repeat("pair", len(a)), names.take(pa.array(b)), pa.array(sums[a, b])]
    which, items, values = zip(*best) if best else ((), (), ())
    tops = [pa.repeat(lang, len(which)), names.take(pa.array(which, type=pa.int64())), pa.repeat("term", len(which)), pa.array(items, type=pa.string()), pa.array(values, type=pa.int64())]
    return pa.concat_tables([pa.table(x, schema=_SUMS) for x in (pairs, tops)])


def audit(docs: DataFrame, least_docs: int = 10, ranks: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: each other source of the language with its divergence, all ranks; part ``term``: the ``ranks`` terms that
    the source holds most in excess of its language. Only terms in ``least_docs`` documents of the language count.
    """
    spark = docs.sparkSession
    # One shuffle: rows that share language and term are together for both groupings.
    counted = partial_counts(docs, lang, source, text).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    merged = counted.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("held"), F.sum("docs").alias("docs"))  # an entry a source
    path = scratch(spark, "terms")
    merged.where(F.col("docs") >= least_docs).select("lang", "term", "held").write.parquet(path)
    terms = spark.read.parquet(path)

    by_lang = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    by_group = terms.select("lang", F.explode("held").alias("h")).groupBy("lang", "h.source").agg(F.sum("h.n").alias("n"))
    plain = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    every = docs.select(plain(lang, "lang"), plain(source, "source")).distinct()
    groups = every.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["n", "kept"])
    groups = groups.join(groups.groupBy("lang").agg(F.sum("n").alias("lang_n")), "lang")

    shards = max(1, -(-terms.count() // SHARD))
    dealt = terms.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)))
    beside = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    met = dealt.groupBy("lang", "shard").cogroup(beside.groupBy("lang", "shard"))
    sums = met.applyInArrow(lambda left, right: shard_sums(left, right, ranks), "lang string, source string, part string, item string, value long")

    # A term lies in one shard, so only pairs have several parts to add.
    added = sums.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ways = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    both = added.select("lang", "part", "value", F.explode(F.coalesce(ways, F.array(F.struct("source", "item")))).alias("w")).select("lang", "w.source", "part", "w.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= ranks)).select("lang", "source", "part", "item", "value", "rank")
