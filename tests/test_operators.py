"""Rule boundaries of the operators on small frames."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import predicates as p
from tallyframe.functions import text as tx
from tallyframe.operators import catalogue, checks, grouping, multivalue, profile, reconcile, relate, sampling, segmentation
from tallyframe.sources import files


@pytest.fixture(scope="module")
def invoices(spark):
    return spark.createDataFrame([(100, "paid"), (200, "open"), (300, "paid"), (400, "open"), (500, "paid")], "amount long, status string")


def one(df):
    return tuple(df.first())


def test_check_aggregates(invoices):
    paid = F.col("status") == "paid"
    a = F.col("amount")
    found = invoices.agg(checks.check_sum(a), checks.check_sum(a, paid), checks.check_count(a), checks.check_avg(a), checks.check_min(a), checks.check_max(a))
    assert tuple(map(int, one(found))) == (1500, 900, 5, 300, 100, 500)
    assert one(invoices.where("false").agg(checks.check_sum(a), checks.check_avg(a))) == (0, None)


def test_assertions(invoices):
    a = F.col("amount")
    good = checks.Check("sum", "invoices", checks.check_sum(a), "=", F.lit(1500))
    bad = checks.Check("sum", "invoices", checks.check_sum(a), "=", F.lit(999))
    found = {r.rhs_value: r for r in checks.run_checks({"invoices": invoices}, [good, bad]).collect()}
    assert found["1500"].passed and not found["999"].passed and found["999"].lhs_value == "1500"


def test_division_by_zero(spark, invoices):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        invoices.select(p.div(F.col("amount"), F.lit(0))).collect()
    assert invoices.where(p.gt(p.div(F.col("amount"), F.lit(0), excluding=True), F.lit(1))).count() == 0


def test_two_valued_logic(spark):
    df = spark.createDataFrame([(None,), (1,)], "x int")
    rows = df.select(p.ne(F.col("x"), F.lit(1)), p.not_(F.col("x") == 1), p.in_list(F.col("x"), [1], negated=True), p.like(F.col("x"), "")).collect()
    assert [tuple(r) for r in rows] == [(True, True, True, True), (False, False, False, False)]


@pytest.mark.parametrize(
    ("value", "expected"),
    [("2024/03/05", "2024-03-05"), ("13/02/2024", "2024-02-13"), ("02/03/2024", "2024-02-03"), ("2-3-2024", "2-3-2024"), (" 2024-01-02 ", "2024-01-02"), (None, "")],
)
def test_date_norm(spark, value, expected):
    assert one(spark.createDataFrame([(value,)], "v string").select(tx.date_norm(F.col("v")))) == (expected,)


def test_text_functions(spark):
    df = spark.createDataFrame([("\u2003Ab1\u00a0",)], "v string")
    v = F.col("v")
    assert one(df.select(tx.trim_(v), tx.shape(tx.trim_(v)), tx.safe_name(F.lit("a:b / c?")), tx.safe_name(F.lit("??")))) == ("Ab1", "Uld", "a-b - c", "unnamed")
    long = one(df.select(F.octet_length(tx.safe_name(F.lit("é" * 150)))))[0]
    assert long == 200
    assert one(df.select(tx.normalize_ref(F.lit("Ctrl-0042")), tx.normalize_ref(F.lit("none")), tx.normalize_risk(F.lit("MED")))) == ("C-42", "none", "Medium")
    assert one(df.select(tx.derive_table_name(F.lit("C:\\x\\My File (2).csv")), tx.derive_table_name(F.lit("b.xlsx [Q1 Data]")))) == ("my_file_2", "q1_data")


def test_segment_takes_the_earliest_start(spark):
    df = spark.createDataFrame([("abab",), ("abx",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(tx.segment(F.col("v"), ["a", "b", "ab", "aba"])).collect()] == [["ab", "ab"], None, None, None]


def test_a_large_vocabulary_still_segments(spark, monkeypatch):
    atoms = ["red", "redgreen", "blue", "green", "ébène", "gold", "pink"]
    cells = ["redgreenblue", "ébènegold", "pinkpink", "nothing", "red", "redgreenblue"]
    df = spark.createDataFrame([(";".join(atoms[i:] + atoms[:i]), c) for i, c in enumerate(cells)], "listed string, packed string")
    small = {tuple(r) for r in multivalue.detect_multi_value({"t": df}).collect()}
    monkeypatch.setattr(multivalue, "MOST_WORDS", 6)
    assert {tuple(r) for r in multivalue.detect_multi_value({"t": df}).collect()} == small
    assert {tuple(r) for r in multivalue.detect_multi_value({"t": df}, atoms).collect()} == small
    assert ("packed", "VocabularySegmented", 6, 4) in {(r.column, r.method, r.total_count, r.multi_value_count) for r in multivalue.detect_multi_value({"t": df}).collect()}


def test_split_by_vocabulary(spark):
    df = spark.createDataFrame([(1, "redblue", "k"), (2, "green", "k"), (3, " zzz ", "k"), (4, "redblue", "k")], "id int, c string, kept string")
    found = multivalue.split_values(df, "c", words=["red", "blue", "green", "re"])
    assert sorted((r.id, r.atom, r.kept) for r in found.collect()) == [(1, "blue", "k"), (1, "red", "k"), (2, "green", "k"), (3, "zzz", "k"), (4, "blue", "k"), (4, "red", "k")]


def test_profile_boundaries(spark):
    rows = [(i, f"u{i}", "x" if i < 2 else "y", None if i else "a@b.c") for i in range(40)]
    df = spark.createDataFrame(rows, "n long, u string, c string, e string")
    found = {(r.column, r.pattern) for r in profile.column_patterns(df, ["n"]).collect()}
    assert found == {("n", "Numeric"), ("n", "Sequential"), ("n", "UniqueIdentifier"), ("u", "UniqueIdentifier"), ("c", "Category"), ("e", "Email")}
    assert [r.column for r in profile.auto_increment(df, ["n"]).collect()] == ["n"]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "a string, status string")
    assert [tuple(r)[2:] for r in profile.profile_columns(df).collect()] == [(0, 0, 0, 0.0)] * 2
    assert profile.top_values(df).count() == profile.column_relations(df).count() == grouping.grouping_dimensions(df).count() == 0
    assert {r.data_type for r in catalogue.infer_types(df).collect()} == {"Boolean"}
    assert multivalue.detect_multi_value({"t": df}, []).count() == 0


def test_relations(spark):
    rows = [(f"k{i}", f"v{i}", f"g{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows, "k string, v string, g string")
    found = {(r.column_a, r.column_b): (r.type, r.strength) for r in profile.column_relations(df).collect()}
    assert found == {("k", "v"): ("OneToOne", 1.0), ("k", "g"): ("ManyToOne", 1.0), ("v", "g"): ("ManyToOne", 1.0)}


def test_reconcile(spark):
    a = spark.createDataFrame([("1", "x", 1), ("2", "y", 2), ("2", "z", 3), ("", "b", 4)], "id string, v string, seq int")
    b = spark.createDataFrame([(" 1 ", "X", 1), ("2", "q", 2), ("9", "n", 3)], "id string, v string, seq int")
    r = reconcile.reconcile(a, b, order_by=["seq"], compare=["v"]).first()
    assert (r.matches, r.only_in_source1, r.only_in_source2, r.duplicates_source1, r.mismatches) == (2, 1, 1, 1, 1)
    m = reconcile.field_mismatches(reconcile.matched_rows(a, b, ["id"], ["seq"]), ["id"], ["v"]).collect()
    assert [tuple(x) for x in m] == [("2", "v", "y", "q")]
    with pytest.raises(ValueError, match="missing"):
        reconcile.reconcile(a, b.withColumnRenamed("id", "no"), keys=["id"], order_by=["seq"])


def test_auto_key():
    assert reconcile.auto_key(["a", "Order ID"], ["order id", "A"]) == ["Order ID"]
    assert reconcile.auto_key(["a", "b"], ["B"]) == ["b"]


def test_systematic_and_mus(spark):
    df = spark.range(10).select(F.col("id"), (F.col("id") * 10 + 1).alias("v"))
    assert sorted(r.id for r in sampling.sample_systematic(df, 3, ["id"], start=1).collect()) == [1, 4, 7]
    hits = sampling.sample_mus(df, "v", 20, ["id"]).collect()
    assert len(hits) == 20
    total = sum(i * 10 + 1 for i in range(10))
    for i in range(10):  # a row as large as the interval is hit
        assert sum(h.id == i for h in hits) >= (i * 10 + 1) * 20 // total
    assert sampling.sample_mus(df.withColumn("v", F.lit(0)), "v", 3, ["id"]).first().method == "random"
    with pytest.raises(ValueError):
        sampling.sample_random(df, 0)


def test_sample_random_is_independent_of_partitions(spark):
    df = spark.range(1000)
    a = {r.id for r in sampling.sample_random(df, 20, seed=5).collect()}
    b = {r.id for r in sampling.sample_random(df.repartition(7), 20, seed=5).collect()}
    assert a == b and len(a) == 20


def test_numbered(spark):
    df = spark.range(100).withColumn("x", 99 - F.col("id")).repartition(5)
    assert all(r.row_no == r.x for r in files.numbered(df, ["x"]).collect())


def test_composite_groups(spark):
    df = spark.createDataFrame([("A - B",), ("A - A",), (" C ",), ("",), (None,)], "g string")
    found = {r.group: r.n for r in grouping.group_sizes(df).collect()}
    assert found == {"A": 3, "B": 1, " C ": 1}


def test_master_record(spark):
    main = spark.createDataFrame([(" A ", 1), ("b", 2), ("", 3)], "k string, x int")
    look = spark.createDataFrame([("a", 9, 2), ("A", 8, 1), ("", 7, 1)], "k2 string, x int, seq int")
    out = relate.master_record({"main": main, "look": look}, "main", [("k", "look", "k2")], {"look": ["seq"]}, {"k": "key"})
    assert out.columns == ["key", "x", "look_x", "seq"]
    assert {(r.x, r.look_x) for r in out.collect()} == {(1, 8), (2, None), (3, None)}


def test_ragged_rows_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception):
        files.read_delimited(spark, str(tmp_path / "a.csv")).collect()


def test_import_mapped(spark):
    df = spark.createDataFrame([("1", None), (None, " ")], "a string, b string")
    assert files.import_mapped(df, {"a": "id"}).columns == ["id", "b"]
    assert files.import_mapped(df, {"a": "id"}, keep_unmapped=False).collect() == [("1",)]


def test_whole_columns_past_any_head(spark):
    rows = [(i, str(i) if i != 150 else "x", str(i if i < 180 else i + 1), "" if i % 9 else "1", f"{i}@b.c" if i == 190 else "n") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, n string, s string, b string, e string")
    head = {(r.column, r.pattern) for r in profile.column_patterns(df, ["k"]).collect()}
    whole = {(r.column, r.pattern) for r in profile.column_patterns(df, ["k"], head=None).collect()}
    assert {("n", "Numeric"), ("n", "Sequential"), ("s", "Sequential")} <= head and ("e", "Email") not in head
    assert ("s", "Numeric") in whole and ("e", "Email") in whole and ("b", "Boolean") in whole and ("k", "Sequential") in whole
    assert not {("n", "Numeric"), ("n", "Sequential"), ("s", "Sequential")} & whole
    assert {r.column for r in profile.auto_increment(df, ["k"], head=None).collect()} == {"k"}
    found = {r.column: (r.n, r.stepwise) for r in profile.sequences(df, ["k"], None).collect()}
    assert found == {"k": (200, True), "n": (199, False), "s": (200, False), "b": (23, False)}


def test_whole_sequences_in_any_number_of_ranges(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") + 7).alias("v"), F.when(F.col("id") != 2500, F.col("id")).alias("gap"))
    for partitions in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found = {r.column: (r.n, r.stepwise) for r in profile.sequences(df, ["k"], None).collect()}
        assert found == {"k": (5000, True), "v": (5000, True), "gap": (4999, False)}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_status_columns_in_all_rows(spark):
    df = spark.range(1500).select("id", F.when(F.col("id") < 1400, "open").otherwise("done").alias("order_status"))
    assert {r.state for r in profile.status_flows(df, ["id"]).collect()} == {"open", "done"}
    assert profile.status_flows(df, ["id"], head=1000).count() == 0


def brute_relation(rows):
    rows = {(a, b) for a, b in rows if a and b}
    of_a, of_b = {}, {}
    for a, b in rows:
        of_a.setdefault(a, set()).add(b)
        of_b.setdefault(b, set()).add(a)
    many = lambda x: sum(len(v) > 1 for v in x.values())
    if not rows:
        return None
    if not many(of_a) and not many(of_b) and len(of_a) > 5:
        return "OneToOne"
    if many(of_a) > 0.5 * len(of_a) and len(of_b) > len(of_a):
        return "OneToMany"
    return "ManyToOne" if many(of_b) > 0.5 * len(of_b) and len(of_a) > len(of_b) else None


@pytest.mark.parametrize("n", [1, 2, 5, 6, 30])
def test_pruned_relations_equal_brute_force(spark, n):
    rows = [(f"u{i}", f"w{i}", "c", f"g{i % 4}", f"h{i // 2}", None if i % 5 else f"p{i}", f"r{min(i, 3)}") for i in range(n)]
    names = ["u", "w", "c", "g", "h", "p", "r"]
    found = {(r.column_a, r.column_b): r.type for r in profile.column_relations(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))).collect()}
    expected = {(a, b): brute_relation([(r[i], r[j]) for r in rows]) for i, a in enumerate(names) for j, b in enumerate(names) if i < j}
    assert found == {k: v for k, v in expected.items() if v}


def test_monetary_units_of_decimals(spark):
    tens = spark.createDataFrame([(i, 0.9) for i in range(10)], "k long, v double")
    found = sampling.sample_mus(tens, "v", 3, ["k"]).collect()
    assert {r.method for r in found} == {"mus"} and [r.k for r in sorted(found)] == [0, 3, 6]
    money = spark.createDataFrame([(1, "0.40"), (2, "1.90"), (3, "-5"), (4, None), (5, "0.70")], "k long, v string").withColumn("v", F.col("v").cast("decimal(12,2)"))
    # Thresholds 0, 0.6, 1.2, 1.8, 2.4 of a total of 3.00.
    assert [(r.k, r.hit) for r in sorted(sampling.sample_mus(money, "v", 5, ["k"]).collect())] == [(1, 0), (2, 0), (2, 1), (2, 2), (5, 0)]
    seeded = [tuple(r) for r in sampling.sample_mus(money, "v", 5, ["k"], seed=11).collect()]
    assert len(seeded) == 5 and seeded == [tuple(r) for r in sampling.sample_mus(money, "v", 5, ["k"], seed=11).collect()]


def test_stratified_rows_with_null_and_repeated_keys(spark):
    rows = [(None, 90), (None, 80), (1, 70), (1, 60), (1, 60), (2, None)]
    df = spark.createDataFrame(rows, "k long, v long")
    for seed in range(4):
        found = [(r.k, r.v, r.stratum) for r in sampling.sample_stratified(df, "v", 6, ["k"], seed).collect()]
        assert sorted(((k, v) for k, v, _ in found), key=str) == sorted(rows, key=str)
        assert sorted(v for _, v, s in found if s == "top") == [70, 80, 90]


def test_random_samples_equal_brute_force(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 37 % 101).alias("v"))
    hashed = sorted(df.select(F.xxhash64(F.lit(3), "k").alias("h"), "k", "v").collect())
    assert {r.k for r in sampling.sample_random(df, 40, seed=3, key=["k"]).collect()} == {r.k for r in hashed[:40]}
    top = {r.k for r in sorted(hashed, key=lambda r: (-r.v, r.k))[:20]}
    rest = [r.k for r in hashed if r.k not in top][:20]
    found = sampling.sample_stratified(df, "v", 40, ["k"], seed=3).collect()
    assert {r.k for r in found if r.stratum == "top"} == top and {r.k for r in found if r.stratum == "random"} == set(rest)


def test_row_numbers_of_text_files(spark, tmp_path):
    lines = [f"{i},v{i}" for i in range(3000)]
    (tmp_path / "a.csv").write_text("id,v\n" + "\n".join(lines[:2000]) + "\n")
    (tmp_path / "b.csv").write_text("id,v\n" + "\n".join(lines[2000:]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = files.read_delimited(spark, str(tmp_path), with_row_no=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.id, r.row_no) for r in sorted(found, key=lambda r: r.row_no)] == [(str(i), i) for i in range(3000)]


def test_values_approximately_counted(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("m"))
    assert [(r.column_name, r.total_values, r.null_count) for r in profile.profile_columns(df, approx=True).orderBy("pos").collect()] == [("id", 1000, 0), ("m", 1000, 0)]


def test_only_differing_rows_are_read_in_full(spark, tmp_path):
    """The scan shows key, order and compared columns; ties go to the smallest cells whatever the partitions."""
    a = spark.range(300).select("id", F.lit(0).alias("seq"), F.concat(F.lit("v"), F.col("id")).alias("v"), F.lit("x" * 50).alias("wide"))
    b = a.withColumn("v", F.when(F.col("id") % 100 == 7, "other").otherwise(F.upper("v")))
    for name, df in (("a", a), ("b", b)):
        df.write.parquet(str(tmp_path / name))
    a, b = (spark.read.parquet(str(tmp_path / x)) for x in "ab")
    rows = reconcile.differing_rows(a, b, ["id"], ["seq"], compare=["v"])
    assert sorted((r.key.k0, r.r1.v, r.r2.v) for r in rows.collect()) == [("107", "v107", "other"), ("207", "v207", "other"), ("7", "v7", "other")]
    scans = rows._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1:]
    assert scans and all("wide" not in x.split(">")[0] for x in scans)
    assert reconcile.reconcile(a, b, ["id"], ["seq"], compare=["v"]).first().mismatches == 3
    assert reconcile.reconcile(a, a, ["id"], compare=["id"]).first().mismatches == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_tied_rows_don_t_depend_on_partitions(spark, partitions):
    a = spark.createDataFrame([(1, c, 0) for c in "dbac"] + [(2, None, 0), (2, "z", 0)], "id int, v string, seq int").repartition(partitions)
    b = spark.createDataFrame([(1, "e", 0), (1, "a", 1), (2, "", 0)], "id int, v string, seq int").repartition(partitions)
    met = reconcile.matched_rows(a, b, ["id"], ["seq"])
    assert sorted((r.key.k0, r.r1.v, r.r2.v) for r in met.collect()) == [("1", "a", "e"), ("2", None, "")]
    one_, two = (reconcile.reconcile(x, y, ["id"], ["seq"], compare=["v"]).first() for x, y in ((a, b), (a.repartition(3), b.repartition(2))))
    assert one_ == two and one_.duplicates_source1 == 4 and one_.matches == 2


def test_column_agreement_equals_brute_force(spark, monkeypatch):
    """100 x 100 columns in one pass, blanks and repeated values in a row included."""
    import random

    r = random.Random(5)
    value = lambda: r.choice([None, "", " ", "A", "a ", "b", "c", "d", "7", "é"])
    left, right = [f"l{i}" for i in range(100)], [f"r{i}" for i in range(100)]
    rows = [(i, *(value() for _ in range(100))) for i in range(30)]
    other = [(i, *(value() for _ in range(100))) for i in range(5, 30)]
    a = spark.createDataFrame(rows, ", ".join(["id int", *(f"{c} string" for c in left)]))
    b = spark.createDataFrame(other, ", ".join(["id int", *(f"{c} string" for c in right)]))
    matched = reconcile.matched_rows(a, b, ["id"], ["id"])
    norm = lambda v: (v or "").strip().lower()
    want = {}
    for x, y in zip(rows[5:], other):
        for i, p in enumerate(x[1:]):
            for j, q in enumerate(y[1:]):
                if norm(p) and norm(q):
                    both, equal = want.get((i, j), (0, 0))
                    want[i, j] = both + 1, equal + (norm(p) == norm(q))
    for limit in (1 << 22, 1 << 14):
        monkeypatch.setattr(reconcile, "MEETINGS", limit)
        found = {(int(x.column1[1:]), int(x.column2[1:])): (x.both, x.equal) for x in reconcile.agreement(matched, left, right).collect()}
        assert found == {(i, j): want.get((i, j), (0, 0)) for i in range(100) for j in range(100)}
    none = reconcile.agreement(matched.where("false"), left[:2], right[:3]).collect()
    assert len(none) == 6 and all((x.both, x.equal) == (0, 0) for x in none)
    assert reconcile.auto_column_mapping(reconcile.matched_rows(a.select("id", F.col("l0").alias("p")), a.select("id", F.col("l0").alias("q")), ["id"], ["id"]), ["id"]) == [("p", "q")]


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_numbering_moves_rows_once_and_keeps_nothing(spark):
    """One exchange of the data whatever columns are asked for, no cached blocks, and ties that don't depend on partitions."""
    df = spark.range(2000).select((F.col("id") % 3).alias("k"), (F.col("id") % 50).alias("v"), F.lit("x").alias("w"))
    wanted = sorted(range(2000))
    for partitions in (1, 7):
        found = files.numbered(df.repartition(partitions), ["k"])
        assert sorted(r.row_no for r in found.collect()) == wanted
        rows = sorted((r.row_no, r.k, r.v) for r in found.collect())
        assert [k for _, k, _ in rows] == sorted(k for _, k, _ in rows)
        assert partitions == 1 or rows == first  # noqa: F821
        first = rows  # noqa: F841
    for chosen in (found, found.select("row_no"), files.prefix_sums(df, "v", ["k"], "total").select("k", "total")):
        plan = _final_plan(chosen)
        assert plan.count("ReusedExchange") == 1 and plan.count("Exchange rangepartitioning") == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    assert files.numbered(df.where("false"), ["k"]).count() == 0


def test_prefix_sums_equal_brute_force(spark):
    import random

    r = random.Random(3)
    rows = [(i, r.choice([None, 0, 5, -7, 10**17])) for i in range(400)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k long, v long")
    for before in (False, True):
        found = files.prefix_sums(df.repartition(6), "v", ["k"], "t", before, "decimal(38,0)").collect()
        total, want = 0, {}
        for k, v in rows:
            want[k] = total + (0 if before else v or 0)
            total += v or 0
        assert {x.k: int(x.t) for x in found} == want


def test_running_totals_are_exact():
    import decimal
    import random

    import pyarrow as pa

    r = random.Random(1)
    with decimal.localcontext() as context:
        context.prec = 60
        for _ in range(50):
            values = [r.choice([0, 1, -1, 10**9, 2**32, -(2**64), 10**33, -(10**33)]) * r.randrange(50) for _ in range(r.randrange(1, 30))]
            start = r.choice([0, -5, 10**20, -(10**30)])
            got, last = files.running_totals(pa.array([decimal.Decimal(0), *map(decimal.Decimal, values)], type=pa.decimal128(38, 0)).slice(1), start)
            want = [start + sum(values[: i + 1]) for i in range(len(values))]
            assert [int(x) for x in got.to_pylist()] == want and last == want[-1]


def test_samples_of_repeated_rows(spark):
    """Rows that repeat are chosen as often as their places are, and other columns come back whole."""
    rows = [(1, 5, "a")] * 40 + [(1, 5, "b")] * 40 + [(None, 9, "c")] * 20
    df = spark.createDataFrame(rows, "k long, v long, w string").repartition(5)
    found = [(r.k, r.v, r.w) for r in sampling.sample_systematic(df, 10, ["k"], start=3).collect()]
    assert len(found) == 10 and sorted(found, key=str) == sorted([(None, 9, "c")] * 2 + [(1, 5, "a")] * 4 + [(1, 5, "b")] * 4, key=str)
    hits = sampling.sample_mus(df, "v", 29, ["k"]).collect()
    assert len(hits) == 29 and sum(r.w == "c" for r in hits) == 9
    top = sampling.sample_stratified(df, "v", 60, ["k"], seed=2).collect()
    assert len(top) == 60 and sum(r.w == "c" for r in top if r.stratum == "top") == 20 and sum(r.stratum == "random" for r in top) == 30
    sample = sampling.sample_stratified(df, "v", 60, ["k"], seed=2)
    assert "Exchange rangepartitioning" not in _final_plan(sample)


def test_row_numbers_of_files_move_no_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join(f"{i},v" for i in range(500)))
    plan = _final_plan(files.read_delimited(spark, str(tmp_path), header=False, with_row_no=True))
    assert "rangepartitioning" not in plan and plan.count("FileScan") <= 2


def test_counts_settle_what_needs_no_sort(spark):
    """Keys over 0.95 distinct, gaps and repeats are settled by counts; what is left is sorted and right."""
    rows = [(i, str(i), str(i * 2), str((i * 7) % 40), str(min(i, 37)), f"x{i}", "") for i in range(40)]
    df = spark.createDataFrame(rows, "k long, up string, gap string, mixed string, near string, name string, none string")
    asked = []
    real = profile._sorted_steps

    def spied(df, order_by, columns):
        asked.append(list(columns))
        return real(df, order_by, columns)

    profile._sorted_steps = spied
    try:
        found = {r.column_name: r.is_key for r in profile.column_keys(df, ["k"], head=None).collect()}
        assert asked == [] and found == {"k": True, "up": True, "gap": True, "mixed": True, "near": False, "name": True, "none": False}
        patterns = {(r.column, r.pattern) for r in profile.column_patterns(df, ["k"], head=None).collect()}
        assert asked == [["up", "mixed"]] and ("up", "Sequential") in patterns and ("mixed", "Sequential") not in patterns and ("k", "Sequential") in patterns
        few = spark.createDataFrame([(i, str(i + 3), str(9 - i)) for i in range(5)], "k long, up string, down string")
        assert [r.column_name for r in profile.primary_key_candidates(few, ["k"], head=None).collect()] == ["k", "up"]
        assert asked[1:] == [["up", "down"]]
    finally:
        profile._sorted_steps = real
    empty = profile.column_keys(df.where("false"), ["k"], head=None).collect()
    assert len(empty) == 7 and not any(r.is_key for r in empty)


def test_inclusion_index_equals_brute_force(spark):
    """Overlaps of all asked pairs of 70 columns, past one word of bits, in one shuffle of values."""
    import random

    r = random.Random(9)
    data = {f"t{t}": [[r.choice([None, "", *"abcdefg", "x1", "x2"]) for _ in range(35)] for _ in range(6 * (t + 1))] for t in range(2)}
    frames = {t: spark.createDataFrame([tuple(x) for x in rows], ", ".join(f"C{i} string" for i in range(35))) for t, rows in data.items()}
    pairs = [("t0", f"c{i}", "t1", f"C{(i * 5) % 35}", "NameMatch", 50) for i in range(35)] + [("t1", "C0", "t1", "C1", "NameMatch", 50), ("t0", "C0", "gone", "x", "NameMatch", 50)]
    schema = "from_table string, from_column string, to_table string, to_column string, kind string, confidence int"
    from tallyframe.operators import relate

    found = {tuple(x)[:4]: (x.confidence, x.overlap_count) for x in relate.score_relationships(spark.createDataFrame(pairs, schema), frames).collect()}
    assert len(found) == 37
    for ft, fc, tt, tc, _, confidence in pairs:
        held = lambda t, c: {x[int(c[1:])] for x in data[t] if x[int(c[1:])]} if t in data else set()
        a, b = held(ft, fc), held(tt, tc)
        assert found[ft, fc, tt, tc] == (min(100, int(0.6 * confidence + 40 * len(a & b) / max(1, min(len(a), len(b))) + 1e-9)), len(a & b))
    assert relate.score_relationships(spark.createDataFrame([], schema), frames).count() == 0


@pytest.mark.parametrize("a_shard", [3, 1000])
def test_segments_equal_brute_force(spark, monkeypatch, a_shard):
    """Words of one byte to many, of any script, in one shard or many; the earliest start wins as in the plain word break."""
    import random

    r = random.Random(4)
    words = ["a", "ab", "aba", "b", "é", "éa", "日本", "本", "x1", "long word", "ab" * 20, "zz", "\x00"]
    values = {"".join(r.choice(words) for _ in range(r.randrange(1, 7))) for _ in range(150)} | {"q", "aq", "日", "", "zzz", "ab" * 21}
    monkeypatch.setattr(multivalue, "MOST_WORDS", a_shard)
    df = spark.createDataFrame([(v,) for v in values] + [(None,), ("ab",)], "value string")
    found = {x.value: x.parts for x in multivalue.segments(df, spark.createDataFrame([(w,) for w in words + [None, "ab"]], "atom string")).collect()}
    want = {v: tx._segments(v, frozenset(words), 40) for v in values}
    assert found == {v: p for v, p in want.items() if p}
    assert multivalue.segments(df, df.where("false").withColumnRenamed("value", "atom")).count() == 0 == multivalue.segments(df.where("false"), df.withColumnRenamed("value", "atom")).count()


def test_two_hundred_thousand_words(spark, monkeypatch):
    """A vocabulary in many shards, without a join of substrings: each value goes to the shards of its places."""
    monkeypatch.setattr(multivalue, "MOST_WORDS", 20_000)
    # Every word ends with a dot, which no other place of it holds, so a cover is unique.
    words = spark.range(200_000).select(F.concat(F.lower(F.hex(F.col("id") * 7919)), F.lit(".")).alias("atom"))
    rows = spark.range(400).select(F.concat(*(F.concat(F.lower(F.hex((F.col("id") * 499 + i) * 7919)), F.lit(".")) for i in range(3)), F.when(F.col("id") % 10 == 0, "?").otherwise("")).alias("value"))
    found = {x.value: x.parts for x in multivalue.segments(rows, words).collect()}
    assert len(found) == 360 and all(len(p) == 3 and "".join(p) == v for v, p in found.items())
    report = multivalue.vocabulary_segmented_report(rows, words).first()
    assert (report.column, report.total_count, report.multi_value_count) == ("value", 400, 360)


def test_patterns_and_lengths_read_cells_once(spark):
    """Cells are counted by shape and by length; no later step has a row a cell."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "Ab1Ab1Ab1").otherwise("Ab1").alias("code"), F.repeat(F.lit("x"), (F.col("id") % 7 + F.when(F.col("id") % 500 == 0, 90).otherwise(1)).cast("int")).alias("note"))
    found = {r.column: (r.total_count, r.multi_value_count) for f in (multivalue.pattern_repetition_report(df, ["code"]), multivalue.length_outlier_report(df, ["note"])) for r in f.collect()}
    assert found == {"code": (3000, 1000), "note": (3000, 6)}
    for report in (multivalue.pattern_repetition_report(df), multivalue.length_outlier_report(df)):
        lines = report._jdf.queryExecution().optimizedPlan().toString().split("\n")
        for i, line in enumerate(lines):
            if "Generate explode" in line:  # the nearest step above that joins or groups is a grouping
                assert next(x for x in reversed(lines[:i]) if "Aggregate [" in x or "Join " in x).count("Aggregate [") == 1



def test_words_with_one_beginning_fill_many_shards(spark, monkeypatch):
    """No shard holds the words that share their first bytes, and a word that is another's beginning is still found."""
    import numpy as np

    monkeypatch.setattr(multivalue, "MOST_WORDS", 400)
    texts = [f"solo{i}" for i in range(5000)] + ["solo", "so", "s", "sol", "spare", "solo1" + "x" * 30]
    words, most = spark.createDataFrame([(w,) for w in texts], "atom string"), 50
    shared = segmentation.shared_prefixes(words, most)
    flat, offsets = segmentation._bytes_of(pa.array(texts))
    whole, size, _ = segmentation._codes(segmentation._trie(shared), flat, offsets[:-1], offsets[1:])
    counts = np.unique([texts[i][:n] for i, n in zip(whole, size)], return_counts=True)[1]
    assert b"solo" in shared and counts.max() <= most and len(texts) - len(whole) < 200
    values = [f"solo{i}spare" for i in range(0, 5000, 50)] + ["sols", "soso", "solosolosolo77", "solo1" + "x" * 30 + "solo4999", "spares", "none", "sparex", "olo1"]
    found = {x.value: x.parts for x in multivalue.segments(spark.createDataFrame([(v,) for v in values], "value string"), words).collect()}
    want = {v: tx._segments(v, frozenset(texts), 40) for v in values}
    assert found == {v: p for v, p in want.items() if p} and len(found) == 105


@pytest.mark.parametrize("partners", [4, 50])
def test_relations_of_thirty_columns(spark, partners):
    """No row is copied for each of 435 pairs: one copy a column, and the same relations as by brute force, blanks included."""
    import random

    r = random.Random(8)
    columns = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(90):
        base = r.randrange(20)
        row = [str(base), str(base // 2), f"x{base}", str(i // 2)]
        rows.append(tuple(row + [r.choice([None, "", " ", *map(str, range(r.choice([2, 5, 30])))]) for _ in range(26)]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    found = {(x.column_a, x.column_b): x.type for x in profile.column_relations(df, most_partners=partners).collect()}
    blank = [tuple(None if v is None or not v.strip() else v for v in row) for row in rows]
    want = {(a, b): brute_relation([(x[i], x[j]) for x in blank]) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j}
    assert found == {k: v for k, v in want.items() if v} and found["c0", "c2"] == "OneToOne"


def test_grouped_sink_names_and_bounds_files(spark, tmp_path):
    """Keys that share a safe name get folders of their own; large groups are several files, small ones one; nothing is lost."""
    rows = [(i, "a/b", "x" * 40) for i in range(600)] + [(i, "a:b", "y") for i in range(600, 605)] + [(i, r"a\b", "z") for i in range(605, 608)] + [(700, "c", None), (701, " ", "none")]
    df = spark.createDataFrame(rows, "id long, g string, v string").repartition(7)
    path = str(tmp_path / "out")
    groups = {r.group_key: r for r in files.write_grouped(df, grouping.group_keys(F.col("g")), path, most_bytes=4000).collect()}
    assert {k: (g.rows, g.files) for k, g in groups.items()} == {"a/b": (600, 8), "a:b": (5, 1), r"a\b": (3, 1), "c": (1, 1)}
    assert groups["a/b"].file_name == "a-b" and len({g.file_name for g in groups.values()}) == 4 and groups["a:b"].file_name.startswith("a-b~")
    back = spark.read.parquet(path)
    assert sorted((r.id, r.group_key, r.v) for r in back.collect()) == sorted((i, g, v) for i, g, v in rows if g != " ")
    assert {(r.group_key, r.file_name) for r in back.collect()} == {(k, g.file_name) for k, g in groups.items()}
    sizes = {k: len(list((tmp_path / "out" / f"file_name={g.file_name}").glob("part-*"))) for k, g in groups.items() if k != r"a\b"}
    assert sizes["c"] == 1 == sizes["a:b"] and 4 <= sizes["a/b"] <= 14


def test_group_names_stay_apart(spark):
    long = "é" * 150
    keys = ["a/b", "a:b", "a|b", long, long + "x", "??", "**"]
    found = {r.group_key: r.file_name for r in files.named_groups(spark.createDataFrame([(k,) for k in keys], "group_key string")).collect()}
    assert len(set(found.values())) == 7 and found["a/b"] == "a-b" and found["**"] == "unnamed" and all(len(n.encode()) <= 200 for n in found.values())


def test_tables_of_a_database(spark, tmp_path):
    """A database's table through JDBC: an embedded database comes with Spark."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url = "jdbc:derby:memory:shop;create=true"
    properties = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame([(1, "a"), (2, None)], "id int, name string").write.jdbc(url, "items", mode="overwrite", properties=properties)
    assert sorted(tuple(r) for r in files.jdbc_table(spark, url, "items", properties).collect()) == [(1, "a"), (2, None)]


def test_mismatches_of_all_pairs(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q")], "id int, v string, w string")
    b = a.withColumn("v", F.upper("v")).withColumn("w", F.lit("q"))
    c = spark.createDataFrame([(2, None)], "id int, v string")
    found = sorted(tuple(r) for r in reconcile.mismatches_all({"a": a, "b": b, "c": c}).collect())
    assert found == [("a", "b", "1", "w", "p", "q"), ("a", "c", "2", "v", "y", None), ("b", "c", "2", "v", "Y", None)]


def test_merged_sketches_equal_one_pass(spark):
    """The profile of three loads from their sketches: exact counts lie within the bounds, decisions are those of exact counts, empty loads too."""
    from tallyframe.operators import sketches

    rows = [(i, i % 7, None if i % 3 else f"m{i % 400}", f"u{i}", "" if i % 2 else "c", min(i, 2850), i % 49, i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, few int, half string, uniq string, one string, near long, cat int, many int")
    parts = [sketches.sketch_columns(df.where(c)) for c in ("k < 1000", "k >= 1000 and k < 2990", "k >= 2990", "false")]
    merged = sketches.merge_sketches(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    exact = {r.column_name: r for r in profile.profile_columns(df).collect()}
    found = {r.column_name: r for r in sketches.sketched_profile(merged).collect()}
    for c, r in found.items():
        assert (r.total_values, r.null_count) == (exact[c].total_values, exact[c].null_count) and r.unique_low <= exact[c].unique_values <= r.unique_high
    settled = {r.column_name: r for r in sketches.settled_profile(df, merged).collect()}
    for c, r in settled.items():
        n, u = exact[c].total_values - exact[c].null_count, exact[c].unique_values
        assert r.category == (u < 0.1 * n and 1 < u < 50) and r.unique_identifier == (u > 0.95 * n and n > 10), c
    assert settled["near"].exact and settled["near"].unique_values == 2851 and settled["cat"].category and not settled["many"].category
    counts = {(r.column, r.value): r.n for r in profile.top_values(df, 3000).collect()}
    top = sketches.sketched_top_values(merged, 7).collect()
    assert {(r.column, r.value) for r in top if r.column == "few"} == {("few", str(i)) for i in range(7)}
    assert all(r.n_low <= counts[r.column, r.value] <= r.n for r in top)


def test_dimensions_of_many_groups_are_left_out_early(spark):
    df = spark.range(5000).select(F.col("id").alias("wide"), (F.col("id") % 5).alias("narrow"), (F.col("id") % 1000).alias("edge"), (F.col("id") % 1001).alias("past"), F.lit("").alias("none"))
    found = {r.column: (r.pos, r.group_count, r.total) for r in grouping.grouping_dimensions(df).collect()}
    assert found == {"narrow": (1, 5, 5000), "edge": (2, 1000, 5000)}
    assert grouping.grouping_dimensions(df.select("wide", "none")).count() == 0


def test_lookup_rows_that_tie_don_t_depend_on_partitions(spark):
    from tallyframe.operators import relate

    sales = spark.createDataFrame([(1, "k")], "id int, code string")
    for partitions in (1, 4):
        codes = spark.createDataFrame([("K ", x, 0) for x in "dbca"] + [("k", "e", 1)], "code string, label string, seq int").repartition(partitions)
        for order in (["seq"], []):
            found = relate.master_record({"sales": sales, "codes": codes}, "sales", [("code", "codes", "code")], {"codes": order}).collect()
            assert [(r.id, r.label) for r in found] == [(1, "a")]
