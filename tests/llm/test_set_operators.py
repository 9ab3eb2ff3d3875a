"""Search, archives, the Jaccard join and the pipeline against brute force."""

import base64
import hashlib
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import jaccard, queries, search, warc
from tallyframe.llm._common import scratch, table
from tests.oracle import compare, connect


def brute_top(ids, matrix, asked, k):
    out = set()
    for i in asked:
        others = [(-int(matrix[i] @ matrix[j]), ids[j]) for j in range(len(ids)) if ids[j] != ids[i]]
        out |= {(ids[i], rank + 1, vec, -score) for rank, (score, vec) in enumerate(sorted(others)[:k])}
    return out


def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(2)
    values = np.round(r.normal(size=(900, 8)), 1)
    values[100:400] = values[100]  # one vector many times: ties go to the smaller id
    rows = [(i, v.tolist(), "x") for i, v in enumerate(values)]
    rows += [(2000, None, "x"), (2020, [float("nan")] * 8, "x"), (2040, [1.0, None], "x"), (None, [1.0] * 8, "x"), (2060, [1.0], "short"), (2080, [], "empty"), (2100, [float("inf")] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    whole = [(i, np.floor(64 * np.pad(np.array(v, dtype=float), (0, 8 - len(v)))).astype(np.int64)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ids, matrix = [i for i, _ in whole], np.array([m for _, m in whole])
    found = search.top_k(df, F.col("vec_id") % 20 == 0, k=20).collect()
    assert {tuple(x) for x in found} == brute_top(ids, matrix, [n for n, i in enumerate(ids) if i % 20 == 0], 20)
    assert len(found) == len({tuple(x) for x in found})
    assert search.top_k(df.where("false"), F.lit(True)).count() == 0
    # Many ranges and tiles; repeated rows, and one vector that a third of the rows hold.
    monkeypatch.setattr(search, "GROUP", 97)
    monkeypatch.setattr(search, "TILE", 16)
    found = search.top_k(df, F.col("vec_id") % 20 == 0, k=20).collect()
    assert {tuple(x) for x in found} == brute_top(ids, matrix, [n for n, i in enumerate(ids) if i % 20 == 0], 20)
    twice = search.top_k(df.unionByName(df).withColumn("rank", F.lit("clash")), F.col("vec_id") % 20 == 0, k=20).collect()
    expected = [(q, 2 * rank - extra, vec, score) for q, rank, vec, score in brute_top(ids, matrix, [n for n, i in enumerate(ids) if i % 20 == 0], 10) for extra in (0, 1)]
    assert sorted(map(tuple, twice)) == sorted(expected)


@pytest.mark.parametrize("scale", [1, 1000, 10**6, 0])
def test_packed_vectors_of_any_width(spark, scale):
    r = np.random.default_rng(scale)
    values = r.integers(-300, 300, size=(60, 5)) * (scale or 1)
    values[59, 0] = values[59, 0] if scale else 2**34  # no row of 64-bit components is asked
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values.astype(float))], "vec_id long, embedding array<double>")
    found = {tuple(x) for x in search.top_k(df, F.col("vec_id") < 7, k=3, scale=1).collect()}
    assert found == brute_top(list(range(60)), values.astype(object), range(7), 3)


def test_blocks_stop_and_stay_exact():
    r = np.random.default_rng(3)
    centres = r.integers(-60, 60, size=(12, 16))
    matrix = np.repeat(centres, 64, axis=0) + r.integers(-3, 4, size=(768, 16))
    ids = np.arange(768)
    at, vec, score = search.Blocks(ids, matrix, 64).top(ids[:40], matrix[:40], 5)
    assert set(zip(ids[at].tolist(), vec.tolist(), score.tolist())) == {(q, v, s) for q, _, v, s in brute_top(ids.tolist(), matrix, range(40), 5)}


@pytest.mark.parametrize("copies", [2, 3, 21, 30])
def test_repeated_query_ids_take_no_place(spark, copies):
    r = np.random.default_rng(copies)
    matrix = r.integers(-50, 51, size=(200, 8))
    matrix[:copies] = 60 * np.sign(matrix[0])  # its own best partner
    ids = [0] * copies + list(range(1, 201 - copies))
    at, vec, score = search.Blocks(np.array(ids), matrix, 256).top(np.array([0]), matrix[:1], 20)
    expected = brute_top(ids, matrix, [0], 20)
    assert sorted(zip(vec.tolist(), score.tolist())) == sorted((v, s) for _, _, v, s in expected)
    df = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in zip(ids, matrix)], "vec_id long, embedding array<double>")
    assert {tuple(x) for x in search.top_k(df, F.col("vec_id") == 0, k=20).collect()} == expected


def test_large_components_stay_exact():
    a = np.array([[2**40, -(2**41)]])
    assert search.scores(a, a).tolist() == [[2**63 - 1]]
    assert search.scores(np.array([[2**30, 3]]), np.array([[2**30, 5]])).tolist() == [[2**60 + 15]]


@pytest.mark.parametrize("compress", [True, False])
def test_archives(spark, compress):
    pages = [(1, "http://a.org/x?y", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, "http://b.org", "same"), (3, "bad url\r\nInjected: 1", "same"), (4, None, None), (5, "http://e", ""), (None, "http://n", "same"), (7, "http://l", "z" * 200_000), (7, "http://l", "z" * 200_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    path = scratch(spark, "w")
    warc.write_archives(df.coalesce(1), path, file_bytes=2000, compress=compress)
    found = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).select("content").collect()]
    assert 1 < len(found) and max(map(len, found)) < (2000 if compress else 210_000)
    if compress:  # every record is a member: none of them but the last leaves bytes when read alone
        rest, members = found[0], []
        while rest:
            tool = zlib.decompressobj(wbits=31)
            members.append(tool.decompress(rest))
            rest = tool.unused_data
        assert len(members) % 3 == 0 and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
    records = warc.read_archives(spark, path, with_payload=True).cache()
    assert records.count() == 3 * len(pages) and records.where("digest_ok = false").count() == 0
    nested = warc.assemble(records).collect()
    assert sum(r.copies for r in nested) == len(pages) and all(r.request and r.response and r.metadata for r in nested)
    by_page = {r.metadata.page_id: r for r in nested}
    assert bytes(by_page[1].response.payload).decode() == pages[0][2]
    assert (by_page[2].response.type, by_page[3].response.type, by_page[None].response.type) == ("revisit", "response", "revisit")
    assert (by_page[4].response.type, by_page[5].response.type, by_page[7].copies) == ("revisit", "response", 2)
    empty = scratch(spark, "w0")
    warc.write_archives(df.where("false"), empty)
    assert warc.assemble(warc.read_archives(spark, empty)).count() == 0


def test_archives_of_one_payload(spark):
    """Very many pages, ids and nulls of one payload, and rows that repeat: every row is there, and only the largest id responds."""
    rows = [(i % 400, "u", "same") for i in range(800)] + [(None, "u", "same")] * 50
    path = scratch(spark, "w1")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    captures = warc.assemble(warc.read_archives(spark, path)).collect()
    assert sum(r.copies for r in captures) == 850 and len(captures) == 401
    assert [r.metadata.page_id for r in captures if r.response.type == "response"] == [399]


def test_warc_query(spark, sf_dir):
    pages = [(r.page_id, (r.html or "").encode()) for r in table(spark, sf_dir, "pages").collect()]
    last = {}
    for i, b in pages:
        last[b] = max(last.get(b, i), i)
    expected = {(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last[b] == i else "revisit", None if last[b] == i else last[b]) for i, b in pages}
    assert {tuple(r) for r in queries.op2_warc_captures(spark, sf_dir).collect()} == expected


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts, k, percent):
    sets = [shingle_set(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i)) for i in range(len(texts))}


def near_copies(seed=4):
    r = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(4000)])
    texts = [None, "", " \t\n", "One two", "one TWO", "a b c", "A b c", "a b c d"]
    passage = r.choice(words, 60)
    for size in (12, 40, 150, 400):
        for _ in range(4):
            base = r.choice(words, size)
            for _ in range(9):
                copy = base.copy()
                at = r.choice(size, r.integers(0, 1 + size // 14), replace=False)
                copy[at] = r.choice(words, len(at))
                texts.append(" ".join(copy if r.random() < 0.7 else np.r_[passage, copy]))
                base = copy if r.random() < 0.4 else base
    return [*texts, texts[-1], texts[-1]]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, k, percent, monkeypatch):
    texts = near_copies()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, sig string")
    expected = brute_components(texts, k, percent)
    columns = ["doc_id", "n_shingles", "component_id"]
    assert {tuple(r) for r in jaccard.components(df, k, percent).select(*columns).collect()} == expected
    assert len({c for _, _, c in expected}) < len(texts) - 20
    # The same through pieces of groups and salted keys.
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 600)
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    monkeypatch.setattr(jaccard, "SALTS", 3)
    assert {tuple(r) for r in jaccard.components(df, k, percent).select(*columns).collect()} == expected


def test_relations_find_what_blocks_leave():
    """A chain of sets, some known to be one block: only the others look for partners, and nothing is lost."""
    r = np.random.default_rng(6)
    sets = [np.sort(r.choice(1 << 20, 100, replace=False)).astype(np.uint64)]
    for _ in range(60):
        new = sets[-1].copy()
        new[r.choice(len(new), 5, replace=False)] = r.choice(1 << 20, 5)
        sets.append(np.unique(new))
    sets += [np.sort(r.choice(1 << 20, 80, replace=False)).astype(np.uint64) for _ in range(20)]
    plain = jaccard.Relations(sets, 80).run()
    block = np.array([0 if i < 30 else i for i in range(len(sets))])
    found = jaccard.Relations(sets, 80, block, block != 0).run()
    assert [(found == x).sum() for x in found] == [(plain == x).sum() for x in plain]


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_pairs_agree_on_a_part(percent):
    """Recall of the candidates, half of them at the threshold's edge: every linked pair shares a part key."""
    r = np.random.default_rng(percent)
    starts, parts = jaccard.classes(percent)
    pairs = missed = 0
    for _ in range(6000):
        n = int(r.integers(2, 70)) if r.random() < 0.8 else int(r.integers(70, 900))
        m = int(r.integers(-(-percent * n // 100), 100 * n // percent + 1))
        least = -(-percent * (n + m) // (100 + percent))  # the smallest intersection at the threshold
        if least > min(n, m):
            continue
        both = least if r.random() < 0.5 else int(r.integers(least, min(n, m) + 1))
        values = r.integers(0, 1 << 64, size=n + m - both, dtype=np.uint64)
        x, y = np.unique(values[:n]), np.unique(np.r_[values[:both], values[n:]])
        pairs += 1
        missed += not len(np.intersect1d(jaccard.part_keys(x, starts, parts, percent), jaccard.part_keys(y, starts, parts, percent)))
    assert pairs > 4000 and missed == 0


def test_prints_of_keys_tell_which_occur_twice(spark, monkeypatch):
    """Packed prints come back as they were, and the table has the bit of every key of two sets, and no other."""
    r = np.random.default_rng(5)
    for most in (50, 1 << 24, 1 << 30, 1 << 40):
        x = np.sort(np.r_[r.integers(0, most, 300), most - 1, most - 1, 0])
        assert (jaccard.unpacked(jaccard.packed(x)) == x).all()
    assert not len(jaccard.unpacked(jaccard.packed(np.empty(0, dtype=np.int64))))
    monkeypatch.setattr(jaccard, "RANGE", 8)
    monkeypatch.setattr(jaccard, "PACKED", 300)
    alone, shared = (r.integers(0, 1 << 64, n, dtype=np.uint64) for n in (3000, 500))
    rows = spark.createDataFrame([(int(x),) for x in np.r_[alone, shared, shared].view(np.int64)], "key long").repartition(7)
    table_, first = jaccard.keys_twice(rows, lambda batches: (b.column("key").to_numpy().view(np.uint64) for b in batches), 4000)
    bits = np.flatnonzero(np.unpackbits(table_, bitorder="little"))
    assert first == 13 and len(table_) == 1024
    assert bits.tolist() == np.unique(shared >> np.uint64(64 - first)).tolist()


def test_jaccard_join_with_a_full_table_of_keys(spark, monkeypatch):
    """Clashes in the table of keys seen twice, and many ranges of prints, change nothing."""
    monkeypatch.setattr(jaccard, "TWICE", 6)
    monkeypatch.setattr(jaccard, "RANGE", 3)
    monkeypatch.setattr(jaccard, "PACKED", 500)
    texts = near_copies(8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = jaccard.components(df, 5, 80).select("doc_id", "n_shingles", "component_id").collect()
    assert {tuple(r) for r in found} == brute_components(texts, 5, 80)


def test_near_duplicates_take_little_disk(spark, tmp_path):
    """Texts without partners are never shuffled, their part keys as prints only, and no shuffle file outlives its step."""
    r = np.random.default_rng(9)
    words = np.array([f"word{i}" for i in range(30_000)])
    rows = [(i, " ".join(r.choice(words, 700))) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    context = spark.sparkContext._jsc.sc()

    def stages():
        gateway = spark.sparkContext._gateway
        found = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s := found.apply(i)).stageId(): s.shuffleWriteBytes() for i in range(found.size())}

    def files():
        return {f for top in context.env().blockManager().diskBlockManager().localDirs() for f in Path(top.getPath()).rglob("shuffle_*.data")}

    size = sum(len(t) for _, t in rows)
    known, there = stages(), files()
    found = jaccard.representatives(spark.read.parquet(str(tmp_path / "in")), 5, 80)
    for _ in range(50):
        if (left := sum(f.stat().st_size for f in files() - there if f.exists())) < 0.02 * size:
            break
        time.sleep(0.2)
    assert left < 0.02 * size
    assert {r.doc_id for r in found.collect()} == set(range(600))
    context.listenerBus().waitUntilEmpty()
    moved = sum(v for k, v in stages().items() if k not in known)
    assert moved < 0.75 * size


@pytest.mark.parametrize("doc_id", [None, 7])
def test_jaccard_join_with_one_id_for_all(spark, doc_id):
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice([f"w{i}" for i in range(5000)], 30)) for _ in range(500)]
    rows = [(doc_id, t + end) for t in texts for end in ("", " more")]
    found = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    sizes = {}
    for x in found:
        sizes[x.group] = sizes.get(x.group, 0) + 1
    assert len(found) == 1000 and set(sizes.values()) == {2} and {x.component_id for x in found} == {doc_id}


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "x y z"), (9, None)], "doc_id long, text string")
    found = sorted(map(tuple, jaccard.components(df, 3, 90).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert found == sorted([(None, 4, 3), (3, 4, 3), (3, 4, 3), (None, 1, None), (9, 0, 9)], key=str)
    assert jaccard.components(df.where("false")).count() == 0
    assert jaccard.representatives(df, 3, 90).where("doc_id is not null").count() == 2
    # One id over unrelated texts: each is its own group and stays; so does the true first of a group.
    more = spark.createDataFrame([(5, "a b c d e f"), (4, "a b c d e f"), (4, "u v w x y z"), (5, "q r s t"), (6, "x" * 300_000 + " y z"), (8, None)], "doc_id long, text string")
    kept = {(r.doc_id, (r.text or "")[:9]) for r in jaccard.representatives(more, 3, 90).collect()}
    assert kept == {(4, "a b c d e"), (4, "u v w x y"), (5, "q r s t"), (6, "x" * 9), (8, "")}


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = scratch(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= n, name
            n = docs.count()
    assert docs.agg(F.countDistinct("doc_id")).first()[0] == n


def test_pipeline_stages_equal_brute_force(spark, sf_dir):
    """Rules, near duplicates and redaction of a table with nulls, empty texts, repeats and secrets, by plain Python."""
    clean = [" ".join(f"w{(i * 97 + j * j * 31 + j) % 9973}" for j in range(70 + i)) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(20, clean[3] + " end"), (21, clean[3]), (5, clean[5]), (None, clean[0] + " no id"), (30, None), (31, ""), (32, "short")]
    rows += [(40, clean[7].replace("w", "v") + " token=abcdefgh1 " + clean[8].replace("w", "z")), (41, "one two three " * 60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    found = {name: stages[name](spark, docs, sf_dir) for name in ("quality rules", "n-gram Jaccard join", "secret scans")}
    assert all(df.columns == docs.columns for df in found.values())
    wanted = {(i, t) for i, t in rows if t and i not in (32, 41)}
    assert {(r.doc_id, r.text) for r in found["quality rules"].collect()} == wanted and found["quality rules"].count() == len([x for x in rows if x in wanted])
    named = [(i, t) for i, t in rows if i is not None]
    kept = {(r.doc_id, r.text) for r in found["n-gram Jaccard join"].collect()}
    assert kept == {(i, t) for i, t in rows if i not in (20, 21)} and found["n-gram Jaccard join"].count() == len(named) - 3 + 1
    redacted = {(r.doc_id, r.text, r.n_chars) for r in found["secret scans"].collect()}
    again = {(i, t and t.replace("token=abcdefgh1", "[assign]")) for i, t in rows}
    assert redacted == {(i, t, None if t is None else len(t)) for i, t in again}
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
    assert stages["quality classifier"](spark, docs, sf_dir).columns == docs.columns
    assert {r.doc_id for r in stages["packing"](spark, docs, sf_dir).collect()} == {i for i, _ in rows}


def test_queries_equal_sql(spark, sf_dir):
    con = connect(sf_dir)
    for name, sql in queries.ORACLE_SQL.items():
        compare(queries.QUERIES[name](spark, sf_dir), con, sql)
