"""Queries of reconciliation and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import reconcile as r
from tallyframe.operators import sampling
from tallyframe.plans.registry import query, table

KEYS, ORDER, COMPARED = ["o_orderkey"], ["seq"], ["o_custkey", "o_orderstatus", "price"]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("price"), F.lit(0).alias("seq")
    )


def _copy(orders: DataFrame) -> DataFrame:
    """The orders without every 97th, some prices and spellings changed, some repeated."""
    k = F.col("o_orderkey")
    changed = orders.where(k % 97 != 0).select(
        "o_orderkey", "o_custkey", F.when(k % 7 == 0, F.concat(F.lit(" "), F.lower("o_orderstatus"), F.lit(" "))).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        (F.col("price") + F.when(k % 53 == 0, 1).otherwise(0)).alias("price"), "seq",
    )
    more = changed.where(k % 31 == 0).withColumn("price", F.col("price") + 7).withColumn("seq", F.lit(1))
    return changed.unionByName(more)


S = """with s1 as (select o_orderkey, o_custkey, o_orderstatus, cast(round(o_totalprice * 100) as bigint) as price, 0 as seq from orders),
c as (select o_orderkey, o_custkey, case when o_orderkey % 7 = 0 then ' ' || lower(o_orderstatus) || ' ' else o_orderstatus end as o_orderstatus,
 price + case when o_orderkey % 53 = 0 then 1 else 0 end as price, seq from s1 where o_orderkey % 97 <> 0),
s2 as (select * from c union all select o_orderkey, o_custkey, o_orderstatus, price + 7, 1 from c where o_orderkey % 31 = 0),
f1 as (select o_orderkey as k, arg_min(o_custkey, seq) as cust, arg_min(o_orderstatus, seq) as status, arg_min(price, seq) as price, count(*) as n from s1 group by 1),
f2 as (select o_orderkey as k, arg_min(o_custkey, seq) as cust, arg_min(o_orderstatus, seq) as status, arg_min(price, seq) as price, count(*) as n from s2 group by 1),
b as (select f1.k as k1, f2.k as k2, f1.cust as cust1, f2.cust as cust2, f1.status as status1, f2.status as status2, f1.price as price1, f2.price as price2,
 f1.n as n1, f2.n as n2 from f1 full join f2 on f1.k = f2.k)
"""


@query(
    S + """select 'source1' as source1, 'source2' as source2, 'o_orderkey' as key_columns, cast(sum(n1) as bigint) as total_source1, cast(sum(n2) as bigint) as total_source2,
count(*) filter (k1 is not null and k2 is not null) as matches, count(*) filter (k2 is null) as only_in_source1, count(*) filter (k1 is null) as only_in_source2,
cast(sum(n1 - 1) as bigint) as duplicates_source1, cast(sum(n2 - 1) as bigint) as duplicates_source2,
cast(sum(case when cust1 <> cust2 then 1 else 0 end + case when lower(trim(status1)) <> lower(trim(status2)) then 1 else 0 end + case when price1 <> price2 then 1 else 0 end) as bigint) as mismatches,
round(100.0 * count(*) filter (k1 is not null and k2 is not null) / greatest(count(k1), count(k2)), 6) as match_percentage from b"""
)
def recon_summary(spark, sf_dir):
    s1 = _orders(spark, sf_dir)
    return r.reconcile(s1, _copy(s1), KEYS, ORDER, compare=COMPARED).withColumn("match_percentage", F.round("match_percentage", 6))


@query(S + "select case when k2 is null then 1 else 2 end as source, cast(coalesce(k1, k2) as varchar) as key_value from b where k1 is null or k2 is null")
def recon_only_in(spark, sf_dir):
    s1 = _orders(spark, sf_dir)
    return r.only_in(s1, _copy(s1), KEYS, ORDER)


@query(S + """, m as (select cast(k1 as varchar) as key_value, 'price' as column_name, cast(price1 as varchar) as source1_value, cast(price2 as varchar) as source2_value from b
where k1 is not null and k2 is not null and price1 <> price2) select * from m order by key_value, column_name limit 100""")
def recon_mismatches(spark, sf_dir):
    s1 = _orders(spark, sf_dir)
    return r.field_mismatches(r.differing_rows(s1, _copy(s1), KEYS, ORDER, compare=COMPARED), KEYS, COMPARED)


@query("""with n as (select lower(trim(l_orderkey::varchar)) || '|' || lower(trim(nullif(l_linenumber, 3)::varchar)) as k, l_orderkey as a, nullif(l_linenumber, 3) as b from lineitem),
g as (select a, coalesce(b, -1) as b, count(*) as n from n group by 1, 2)
select count(*) as keys, cast(sum(n - 1) as bigint) as duplicates, count(*) filter (b = -1) as blank_keys from g""")
def recon_composite_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif(F.col("l_linenumber"), F.lit(3)).alias("l_linenumber"))
    keys = ["l_orderkey", "l_linenumber"]
    found = lines.groupBy(r.recon_key(lines, keys).alias("key")).agg(F.count("*").alias("n"))
    blank = found.agg(F.count("*").alias("keys"), F.count_if(F.col("key.k1") == "").alias("blank_keys"))
    return blank.join(F.broadcast(r.duplicate_keys(lines, keys)))  # one row each


@query("""with m as (select a.c_custkey, a.c_mktsegment as x, cast(round(a.c_acctbal * 100) as bigint) as y from customer a where c_custkey % 11 <> 0),
p as (select * from (values ('c_mktsegment', 'segment'), ('c_mktsegment', 'balance'), ('balance_cents', 'segment'), ('balance_cents', 'balance')) t(column1, column2)),
s as (select column1, column2, (select count(*) from m) as "both", case when column1 = 'c_mktsegment' and column2 = 'segment' or column1 = 'balance_cents' and column2 = 'balance'
then (select count(*) from m) else 0 end as equal from p) select column1, column2, "both", equal, equal > 0 as mapped from s""")
def recon_auto_mapping(spark, sf_dir):
    s1 = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("long").alias("balance_cents"))
    s2 = s1.where("c_custkey % 11 <> 0").select("c_custkey", F.upper("c_mktsegment").alias("segment"), F.col("balance_cents").alias("balance"))
    matched = r.matched_rows(s1, s2, ["c_custkey"], ["c_custkey"])
    pairs = r.auto_column_mapping(matched, ["c_custkey"])
    mapped = F.lit(False)
    for a, b in pairs:
        mapped = mapped | ((F.col("column1") == a) & (F.col("column2") == b))
    return r.agreement(matched, ["c_mktsegment", "balance_cents"], ["segment", "balance"]).withColumn("mapped", mapped)


@query("""with a as (select c_custkey as id, c_name as name from customer), b as (select * from a where id % 5 <> 0), c as (select id, case when id % 3 = 0 then name || 'x' else name end as name from a where id % 2 = 0),
p as (select 'a' as source1, 'b' as source2, x.id as i, y.id as j, x.name as m, y.name as n from a x full join b y on x.id = y.id
union all select 'a', 'c', x.id, y.id, x.name, y.name from a x full join c y on x.id = y.id union all select 'b', 'c', x.id, y.id, x.name, y.name from b x full join c y on x.id = y.id)
select source1, source2, 'cust_id' as key_columns, count(i) as total_source1, count(j) as total_source2, count(*) filter (i = j) as matches, count(*) filter (j is null) as only_in_source1,
count(*) filter (i is null) as only_in_source2, 0::bigint as duplicates_source1, 0::bigint as duplicates_source2, count(*) filter (i = j and m <> n) as mismatches,
100.0::double * count(*) filter (i = j) / greatest(count(i), count(j)) as match_percentage from p group by 1, 2""")
def recon_all_pairs(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust_id"), F.col("c_name").alias("name"))
    c = a.where("cust_id % 2 = 0").withColumn("name", F.when(F.col("cust_id") % 3 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    return r.reconcile_all({"a": a, "b": a.where("cust_id % 5 <> 0"), "c": c})


@query()
def sample_random(spark, sf_dir):
    return sampling.sample_random(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 100, seed=7, key=["o_orderkey"])


@query("""with p as (select o_orderkey, o_custkey, row_number() over (order by o_orderkey) - 1 as pl, count(*) over () as n from orders)
select o_orderkey, o_custkey from p where pl - 3 >= 0 and (pl - 3) % (n // 60) = 0 and (pl - 3) // (n // 60) < 60""")
def sample_systematic(spark, sf_dir):
    return sampling.sample_systematic(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 60, ["o_orderkey"], start=3)


@query("""with v as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents from orders), p as (select * from v where cents > 0),
c as (select o_orderkey, cents, sum(cents) over (order by o_orderkey rows unbounded preceding) as b, sum(cents) over () as t from p),
h as (select o_orderkey, cents, least(greatest(ceil((b - cents - 5)::decimal(38,0) * 50 / t), 0), 50)::int as x, least(greatest(ceil((b - 5)::decimal(38,0) * 50 / t), 0), 50)::int as y from c)
select o_orderkey, cents, unnest(range(0, y - x))::int as hit, 'mus' as method from h where y > x""")
def sample_mus(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return sampling.sample_mus(orders, "cents", 50, ["o_orderkey"], start=5)


@query("select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents, 'top' as stratum from orders order by cents desc, o_orderkey limit 40")
def sample_stratified(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return sampling.sample_stratified(orders, "cents", 80, ["o_orderkey"], seed=3).where("stratum = 'top'")


@query()
def sample_stratified_rest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return sampling.sample_stratified(orders, "cents", 80, ["o_orderkey"], seed=3).where("stratum = 'random'")
