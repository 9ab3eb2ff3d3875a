"""Queries of text normalisers and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import text as tx
from tallyframe.plans.registry import query, table, trimmed


@query(f"""select c_custkey, upper(coalesce(case when c_custkey % 9 = 0 then null else c_name end, '')) as up, lower(c_mktsegment) as low, cast(length(coalesce(case when c_custkey % 9 = 0 then null else c_name end, '')) as int) as len,
{trimmed("chr(9) || ' ' || c_name || chr(10)")} as trimmed, lower({trimmed("'  ' || c_mktsegment || ' '")}) as normal, abs(cast(round(c_acctbal * 100) as bigint)) as cents from customer""")
def string_fns(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 9 != 0, F.col("c_name"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", tx.upper_(name).alias("up"), tx.lower_(F.col("c_mktsegment")).alias("low"), tx.length_(name).alias("len"),
        tx.trim_(F.concat(F.lit("\t "), "c_name", F.lit("\n"))).alias("trimmed"), tx.normalize_value(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("normal"),
        tx.abs_(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"),
    )


@query("select event_id, strftime(ts, '%Y-%m-%d') as slashed, strftime(ts, '%Y-%m-%d') as iso, case when day(ts) > 12 then strftime(ts, '%Y-%m-%d') else strftime(ts, '%Y-') || strftime(ts, '%d-%m') end as day_first, strftime(ts, '%d.%m.%Y') as other from events")
def date_norm(spark, sf_dir):
    as_ = lambda fmt: F.date_format("ts", fmt)
    return table(spark, sf_dir, "events").select(
        "event_id", tx.date_norm(as_("yyyy/MM/dd")).alias("slashed"), tx.date_norm(F.concat(F.lit(" "), as_("yyyy-MM-dd"))).alias("iso"),
        tx.date_norm(as_("dd/MM/yyyy")).alias("day_first"), tx.date_norm(as_("dd.MM.yyyy")).alias("other"),
    )


@query("select p_partkey, cast(round_even(p_size + 0.5, 0) as bigint) as half, cast(round_even(cast(p_size as decimal(18,3)) / 8, 2) * 100 as bigint) as eighth from part")
def round_half_even(spark, sf_dir):
    size = F.col("p_size").cast("decimal(18,3)")
    return table(spark, sf_dir, "part").select("p_partkey", tx.round_(size + F.lit("0.5").cast("decimal(2,1)")).cast("long").alias("half"), (tx.round_((size / 8).cast("decimal(18,3)"), 2) * 100).cast("long").alias("eighth"))


@query(r"""select p_partkey, regexp_replace(regexp_replace(regexp_replace(p_brand || ' ' || p_name, '\p{Lu}', 'U', 'g'), '\p{Ll}', 'l', 'g'), '[0-9]', 'd', 'g') as shape,
cast((length(p_name) - length(replace(p_name, 'a', ''))) as int) as n_a from part""")
def shape(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.shape(F.concat_ws(" ", "p_brand", "p_name")).alias("shape"), tx.count_non_overlapping(F.col("p_name"), F.lit("a")).alias("n_a"))


@query(r"select doc_id, md5(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) as clean from documents")
def clean_cell(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.clean_cell(F.col("text")).cast("binary")).alias("clean"))


@query("""select p_partkey, 'a-b-c(' || p_brand || ')' as safe, 'unnamed' as blank from part""")
def safe_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.safe_name(F.concat(F.lit('a:b/c?<'), "p_brand", F.lit('>"'))).alias("safe"), tx.safe_name(F.lit(" ?* ")).alias("blank"))


@query("select p_partkey, case when p_size % 3 = 0 then p_brand || '+' || p_type when p_size % 3 = 1 then p_brand || '+x' else p_brand end as parts from part")
def composite(spark, sf_dir):
    size = F.col("p_size")
    cell = F.when(size % 3 == 0, F.concat("p_brand", F.lit(" - "), "p_type")).when(size % 3 == 1, F.concat(F.lit(" ;"), "p_brand", F.lit("; x ;"))).otherwise(F.concat("p_brand", F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.composite_parts(cell), "+").alias("parts"))


@query(r"select s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '_') as stem, 'sheet_' || s_suppkey as sheet from supplier")
def table_name(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", tx.derive_table_name(F.concat(F.lit("/data/in/"), "s_name", F.lit(".csv"))).alias("stem"),
        tx.derive_table_name(F.concat(F.lit("book.xlsx [Sheet "), "s_suppkey", F.lit("]"))).alias("sheet"),
    )


@query("""select c_custkey, case c_custkey % 4 when 0 then 'High' when 1 then 'Medium' when 2 then 'Low' else c_mktsegment end as risk, 'C-' || c_custkey as ref, c_mktsegment as no_ref from customer""")
def control_norm(spark, sf_dir):
    k = F.col("c_custkey")
    risk = F.when(k % 4 == 0, "H").when(k % 4 == 1, "moderate").when(k % 4 == 2, "LOW").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", tx.normalize_risk(risk).alias("risk"), tx.normalize_ref(F.concat(F.lit("ctrl 00"), k)).alias("ref"), tx.normalize_ref(F.col("c_mktsegment")).alias("no_ref")
    )


@query("""select page_id, url like 'http://%' or url like 'https://%' as url, contains(url, '@') and contains(url, '.') as email, (url like '%/%/%' or url like '%-%-%') and regexp_matches(url, '[0-9]') as dated,
regexp_full_match(cast(page_id as varchar) || case when page_id % 3 = 0 then 'x' else '.5' end, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') as number, page_id % 2 = 0 as bool from pages""")
def text_tests(spark, sf_dir):
    k, url = F.col("page_id"), F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", tx.looks_like_url(url).alias("url"), tx.looks_like_email(url).alias("email"), tx.looks_like_date(url).alias("dated"),
        tx.is_numeric_text(F.concat(k, F.when(k % 3 == 0, "x").otherwise(".5"))).alias("number"), tx.is_boolean_text(F.when(k % 2 == 0, "Yes").otherwise("maybe")).alias("bool"),
    )


@query("""select p_partkey, round(case when lower(p_name) = lower(p_type) then 1.0 else 1 - levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type)) end, 6) as alike from part
union all select a.n_nationkey * 100 + b.n_nationkey, round(case when a.n_name = b.n_name then 1.0 else 1 - levenshtein(lower(a.n_name), lower(b.n_name)) / greatest(length(a.n_name), length(b.n_name)) end, 6)
from nation a join nation b on a.n_regionkey = b.n_regionkey""")
def name_similarity(spark, sf_dir):
    alike = lambda x, y: F.round(tx.name_similarity(F.col(x), F.col(y)), 6).alias("alike")
    n = table(spark, sf_dir, "nation")
    a, b = (n.select("n_regionkey", F.col("n_nationkey").cast("long").alias(f"{x}k"), F.col("n_name").alias(x)) for x in "ab")
    nations = a.join(b, "n_regionkey").select((F.col("ak") * 100 + F.col("bk")).alias("p_partkey"), alike("a", "b"))
    return table(spark, sf_dir, "part").select("p_partkey", alike("p_name", "p_type")).unionByName(nations)
