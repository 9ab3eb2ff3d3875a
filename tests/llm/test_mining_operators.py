"""The source audit, hard negatives and toxicity against brute force, and their edges."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm import divergence, negatives, queries, toxicity
from tallyframe.llm._common import table

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, docs string"


def plain_audit(rows, least_docs, ranks):
    """Pairs and terms by dictionaries and Python's whole numbers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, held = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        docs[lang or ""].update(set(terms))
        held[lang or ""][source or ""].update(terms)
    out = []
    for lang, sources in held.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in sources.items()}, share(sum(sources.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def audited(df, **options):
    return sorted(map(tuple, divergence.audit(df, **options).collect()))


@pytest.mark.parametrize("held, shard, cells", [(1 << 19, 1 << 13, 1 << 21), (4, 3, 5)])
def test_audit_equals_brute_force(spark, monkeypatch, held, shard, cells):
    """Nulls, empty texts, repeated rows, capitals beyond A-Z, a language of one source and one without kept terms."""
    for name, value in (("HELD", held), ("SHARD", shard), ("CELLS", cells)):
        monkeypatch.setattr(divergence, name, value)
    r = np.random.default_rng(1)
    words = ["Éa", "éa", "ab", "AB", "ß", "日本", "x\x00y", "a1b", "don't", "z" * 40]
    rows = [(" ".join(r.choice(words, size=r.integers(0, 12))), f"l{r.integers(2)}", f"s{r.integers(4)}") for _ in range(60)]
    rows += [(None, "l0", "s9"), ("", None, None), ("ab ab", None, "s0"), ("once", "rare", "a"), ("twice", "rare", "b"), ("ab " * 4, "alone", "one")] + [("ab Éa", "l1", "s1")] * 5
    df = spark.createDataFrame([(i, *x, 7, "t", "d") for i, x in enumerate(rows)], SCHEMA).repartition(5)
    assert audited(df, least_docs=3, ranks=2) == plain_audit(rows, 3, 2)
    pairs = [x for x in audited(df, least_docs=3, ranks=2) if x[0] == "rare"]
    assert pairs == [("rare", "a", "pair", "b", 0, 1), ("rare", "b", "pair", "a", 0, 1)]
    assert audited(df.where("false")) == []


def test_audit_of_a_hot_source_and_a_long_text(spark):
    rows = [("alpha beta " * 30_000, "en", "hot")] + [(f"beta gamma w{chr(97 + i % 26)}", "en", "hot") for i in range(300)] + [("beta delta", "en", f"s{i}") for i in range(40)]
    df = spark.createDataFrame([(i, *x, 7, "t", "d") for i, x in enumerate(rows)], SCHEMA)
    assert audited(df) == plain_audit(rows, 10, 10)


@given(st.lists(st.tuples(st.integers(0, 10**12), st.integers(0, 10**15)), min_size=1, max_size=20), st.integers(1, 10**6))
def test_probabilities_are_exact(pairs, kept):
    counts, totals = (np.array(x, dtype=np.int64) for x in zip(*pairs))
    assert divergence.probability(counts, totals, kept).tolist() == [1 + 10**9 * (c + 2) // (n + 2 * kept) for c, n in pairs]


def plain_negatives(rows, every, positives, negatives_, low, high, scale):
    """All scores by whole numbers; rows are (id, vector, label)."""
    good = [(i, [int(np.floor(scale * float(x))) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in good), default=0)
    good = [(i, v + [0] * (width - len(v)), y) for i, v, y in good]
    out = []
    for anchor in sorted({i for i, _, _ in good if i % every == 0}):
        _, v, y = next(x for x in good if x[0] == anchor)
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i, z) for i, w, z in good if i != anchor)
        for s, i, _ in [x for x in scored if x[2] == y][:positives]:
            found = [(n, t) for t, n, z in scored if z != y and low * -s <= 100 * -t <= high * -s]
            out += [(anchor, i, k + 1, n, -s, -t) for k, (n, t) in enumerate(found[:negatives_])]
    return sorted(out)


def mined(df, every, **options):
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % every == 0, F.col("label"), **options).collect()))


@pytest.mark.parametrize("bucket, least, tile", [(1024, 1 << 11, 1 << 16), (16, 8, 4)])
def test_negatives_equal_brute_force(spark, monkeypatch, bucket, least, tile):
    """Nulls, non-finite and short vectors, zeros, ties, a hot label, and long and short vectors."""
    for name, value in (("BUCKET", bucket), ("LEAST", least), ("TILE", tile)):
        monkeypatch.setattr(negatives, name, value)
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(size=8) * r.choice([0.1, 1, 5])).round(1).tolist(), int(r.choice([0, 0, 0, 1, 2, 3]))) for i in range(240)]
    rows += [(240, None, 1), (241, [1.0] * 8, None), (242, [1.0, None] * 4, 1), (243, [float("nan")] * 8, 1), (244, [float("inf")] + [0.0] * 7, 1), (None, [1.0] * 8, 1)]
    rows += [(250, [0.0] * 8, 0), (251, [0.0] * 8, 1), (255, [2.0, 1.0], 2), (260, [2.0, 1.0], 2), (261, [1.0, 1.0], 3), (262, [1.0, 1.0], 3), (270, [1.0], 77)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("size", F.lit("x")).withColumn("part", F.lit(1)).repartition(6)
    for options in ({"positives": 5, "negatives_": 10, "low": 30, "high": 90}, {"positives": 2, "negatives_": 1, "low": 0, "high": 50}):
        given_ = {k.rstrip("_"): v for k, v in options.items()}
        assert mined(df, 5, scale=256, **given_) == plain_negatives(rows, 5, **options, scale=256)
    assert mined(df.where("false"), 5) == [] == mined(df.where("vec_id = 270"), 5)


def test_repeated_ids_and_rows(spark):
    """An anchor that repeats is asked once and never meets itself; other repeated rows count each."""
    rows = [(10, [1.0, 0.0], 1)] * 3 + [(1, [1.0, 0.0], 1)] * 2 + [(2, [0.5, 0.5], 2)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = mined(df, 10, positives=1, negatives=10)
    assert found == [(10, 1, k, 2, 65536, 32768) for k in (1, 2, 3)]


@settings(deadline=None)
@given(st.integers(0, 10**6), st.floats(-0.5, 1.0), st.sampled_from([0.3, 1.0, 4.0]))
def test_feasible_ranges_lose_no_row(seed, cosine, spread):
    """Every row at the threshold or above is verified, and pruning happens where vectors lie close together."""
    r = np.random.default_rng(seed)
    centre = r.normal(size=12) * 40
    rows = np.round(centre + r.normal(size=(200, 12)) * 40 * spread).astype(np.int64)
    query = np.round(centre + r.normal(size=(3, 12)) * 10).astype(np.int64)
    bucket, sizes = negatives.Bucket(np.arange(200), np.zeros(200), rows), negatives.lengths(query)
    least = cosine * sizes * bucket.longest
    exact = query @ rows.T
    found, _ = bucket.found(query, sizes, np.argsort(-np.abs(query), axis=1)[:, : negatives.FOCUS], least)
    at = exact >= least[:, None]
    assert (found[at] == exact[at]).all() and np.isin(found, [*np.unique(exact), negatives.LOWEST]).all()


def test_ranges_prune_clustered_vectors():
    r = np.random.default_rng(3)
    centres = r.normal(size=(10, 32))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = np.round(256 * (centres[np.arange(1000) % 10] + r.normal(size=(1000, 32)) * 0.01)).astype(np.int64)
    bucket = negatives.Bucket(np.arange(1000), np.zeros(1000), rows)
    query, exact = rows[:10], rows[:10] @ rows.T
    least = np.sort(exact, axis=1)[:, -20].astype(float)
    found, seen = bucket.found(query, negatives.lengths(query), np.argsort(-np.abs(query), axis=1)[:, : negatives.FOCUS], least)
    assert (found[exact >= least[:, None]] == exact[exact >= least[:, None]]).all() and seen < 0.3 * exact.size




def labelled(spark, n=240, seed=4):
    r, rows = np.random.default_rng(seed), []
    letters = list("abcdefghijklmnop")
    for i in range(n):
        words = ["".join(r.choice(letters, size=r.integers(2, 9))) for _ in range(r.integers(5, 60))]
        toxic = int(i % 3 == 0)
        if toxic:
            words[r.integers(len(words))] = f"zork{''.join(r.choice(letters, size=3))}" if i % 2 else "Quux"
        rows.append((i, " ".join(words), "en" if i % 2 else None, toxic))
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string").withColumn("toxic", F.lit("clash"))
    return docs, spark.createDataFrame([(x[0], x[3]) for x in rows], "doc_id long, toxic int"), rows


def test_toxicity_on_held_out_rows(spark):
    """Inflected forms that training never saw are known by their stems; language is no input of the score."""
    docs, labels, rows = labelled(spark, 900)
    found = toxicity.score_documents(docs, toxicity.train(docs, labels))
    held = {r.doc_id: r for r in found.where(toxicity.fold(F.col("doc_id")) == 1).collect()}
    truth = {i: t for i, _, _, t in rows}
    good = [(r.score >= 0.7) == bool(truth[i]) for i, r in held.items()]
    assert len(held) > 200 and np.mean(good) > 0.97
    assert np.mean([r.flagged == bool(truth[i]) for i, r in held.items()]) > 0.97
    other = toxicity.score_documents(docs.withColumn("lang", F.lit("xx")), toxicity.train(docs, labels))
    assert {r.doc_id: r.score for r in other.collect()} == {r.doc_id: r.score for r in found.collect()}


def test_toxicity_on_the_given_labels(spark):
    """Of held-out rows most toxic ones are found and nearly all others left alone, with few labels too."""
    sf_dir = "/root/testdata/sf0.1"
    found = queries.op13_toxicity(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("held_out").toPandas()
    assert (found.score.between(0, 1)).all() and (found.predicted == (found.score >= 0.7)).all()
    assert found[found.toxic == 1].predicted.mean() > 0.6 and found[found.toxic == 0].predicted.mean() < 0.02
    toxic, clean = found[found.toxic == 1].score.values, found[found.toxic == 0].score.values
    assert (toxic[:, None] > clean[None]).mean() > 0.95


def test_toxicity_edges(spark):
    docs, labels, _ = labelled(spark, 60)
    edge = spark.createDataFrame([(1, None, "en"), (2, "", None), (None, "quux " * 200_000, "en"), (4, "12 34", "en"), (4, "12 34", "en")], "doc_id long, text string, lang string")
    classifier = toxicity.train(docs, labels)
    found = toxicity.score_documents(edge, classifier).collect()
    assert len(found) == 5 and len({r.score for r in found if r.doc_id is not None}) == 1 and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score_documents(edge.where("false"), classifier).count() == 0
    assert toxicity.score_documents(edge.drop("lang"), classifier).count() == 5
    one = toxicity.train(docs, labels.where("toxic = 1"))
    assert all(r.score > 0.99 for r in toxicity.score_documents(edge, one).collect())
    none = toxicity.train(docs.where("false"), labels.where("false"))
    assert all(r.score < 1e-9 for r in toxicity.score_documents(edge, none).collect())
    assert 0 <= toxicity.score_documents(edge, toxicity.train(docs.where("false"), labels)).first().score <= 1


def test_training_sees_no_held_out_row(spark):
    docs, labels, rows = labelled(spark, 120)
    swapped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x).network for x in (labels, swapped))
    assert (a.table == b.table).all() and a.base == b.base
    assert {zlib.crc32(str(i).encode()) % 3 for i, *_ in rows} == {0, 1, 2}


@pytest.mark.parametrize("window", [5, 1 << 16])
def test_scores_equal_plain_loops(monkeypatch, window):
    """Every window of words of a text, one by one, on words of any script."""
    monkeypatch.setattr(toxicity, "WINDOW", window)
    net, r = toxicity.Network(), np.random.default_rng(5)
    net.shift, net.out = r.normal(size=net.shift.shape).astype(np.float32), r.normal(size=net.out.shape).astype(np.float32)
    texts = ["One two one THREE four", "", "été Été 日本語 x", "a", "... 12", "word " * 40]
    got = net.logit(pa.array(texts))
    for text, logit in zip(texts, got):
        words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        vectors = [net.embed(toxicity.hashed(pa.array([w])))[0] for w in words] + [np.zeros(toxicity.DIM)]
        high = []
        for f in net.filters:
            every = vectors + [np.zeros(toxicity.DIM)] * 2
            high += list(np.max([sum(every[i + k] @ f[k] for k in range(len(f))) for i in range(len(vectors))], axis=0))
        assert abs(net.active(np.array(high)) @ net.out + net.last[0] - logit) < 1e-3


def test_words_share_prefixes_and_copies_train_once():
    words = pa.array(["lowerung", "loweres", "low", "Ünder"])
    b = toxicity.hashed(words)
    assert (b[0, 1:3] == b[1, 1:3]).all() and b[0, 0] != b[1, 0] and (b[2, 1:] == toxicity.BUCKETS).all() and (b >= 0).all()
    texts = ["the quick brown fox jumps over the lazy dog again"] * 2 + ["the quick brown fox jumps over the lazy dog again and more", "something else is written here today", ""]
    w, codes, offsets = toxicity.words_of(pa.array(texts))
    assert toxicity.distinct_texts(codes, offsets, toxicity.hashed(w)).tolist() == [0, 3, 4]


def test_every_labelled_text_trains(spark, monkeypatch):
    """Past 2,000 rows of a class and long texts too; the counts of all shards together are those of plain loops over all texts."""
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(i, " ".join(f"{x}{name(i)}" for x in ("plain" if i % 4 else "awful", "b", "c", "d", "e", "f", "g", "h")), int(i % 4 == 0)) for i in range(9000)]
    rows += [(9001, "filler " * 300_000 + "longone", 1), (9002, "filler plain", 0)]
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD", 1 << 16)
    known = labels.where(toxicity.fold(F.col("doc_id")) != 1)
    found = toxicity.training_rows(docs, known, "doc_id", "text", "lang")
    want = {(i, t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {(r.doc_id, r.toxic) for r in found.select("doc_id", "toxic").collect()} == want and len(want) > 5000
    assert found.select("shard").distinct().count() > 4
    by_hand = np.zeros((2, toxicity.BUCKETS + 1), dtype=np.int64)
    texts = {i: text for i, text, _ in rows}
    for i, t in want:
        words = toxicity.words_of(pa.array([texts[i]]))[0]
        by_hand[t, np.unique(toxicity.hashed(words))] += 1
    assert (toxicity.bucket_counts(found) == by_hand[:, : toxicity.BUCKETS]).all()


def test_near_copies_are_found_as_in_order(spark):
    """The tables of hashes choose the texts that a plain pass in order of ids chooses; of a repeated id one text trains."""
    r = np.random.default_rng(2)
    base = [" ".join("".join(r.choice(list("abcdef"), size=4)) for _ in range(30)) for _ in range(12)]
    texts = []
    for i in range(150):
        words = base[r.integers(12)].split()
        for _ in range(int(r.integers(0, 6))):
            words[r.integers(len(words))] = "new" + "x" * int(r.integers(1, 9))
        texts.append(" ".join(words))
    texts += ["", "", "one", "one", "two words"]
    docs, known = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, toxic int")
    w, codes, offsets = toxicity.words_of(pa.array(texts))
    found = toxicity.training_rows(docs.repartition(5), known, "doc_id", "text", "lang")
    assert sorted(x.doc_id for x in found.collect()) == toxicity.distinct_texts(codes, offsets, toxicity.hashed(w)).tolist()
    again = toxicity.training_rows(docs.unionByName(docs).unionByName(docs.withColumn("text", F.lit("other"))), known, "doc_id", "text", "lang").collect()
    assert len({x.doc_id for x in again}) == len(again)
