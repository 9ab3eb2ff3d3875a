"""Queries of sources, catalogues and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import catalogue, profile, relate, sketches
from tallyframe.plans.registry import query, table, unpivoted
from tallyframe.sources import files

EVENTS = ["event_id", "user_id", "event_type"]
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _texts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) for c in columns))


def _counts_sql(source: str, columns: list[str], name: str) -> str:
    return f"""with u as ({unpivoted(source, columns)}), c as (select pos, "column", value, count(*) as n from u group by all)
select '{name}' as source, pos, "column" as column_name, cast(sum(n) as bigint) as total_values, count(value) as unique_values, cast(coalesce(sum(n) filter (value is null), 0) as bigint) as null_count,
round(count(value) / sum(n), 6) as distinct_ratio from c group by all"""


@query(f"select * from ({_counts_sql('events', EVENTS, 'events')}) union all select * from ({_counts_sql('part', PART, 'part')})")
def profile_columns(spark, sf_dir):
    one = lambda n, cs: profile.profile_columns(_texts(table(spark, sf_dir, n), cs)).select(F.lit(n).alias("source"), "*")
    return one("events", EVENTS).unionByName(one("part", PART)).withColumn("distinct_ratio", F.round("distinct_ratio", 6))


@query(f"""with u as ({unpivoted('orders', ORDERS)}), c as (select pos, "column", count(distinct value) as d, count(value) as n, count(*) as total_values, count(*) - count(value) as null_count from u group by all)
select "column" as column_name, total_values, null_count, d < 0.1 * n and d between 2 and 49 as category, d > 0.95 * n and n > 10 as unique_identifier from c""")
def profile_merged(spark, sf_dir):
    """The profile of orders from the sketches of three loads; what the bounds leave open is counted."""
    orders = _texts(table(spark, sf_dir, "orders"), ORDERS)
    loads = [sketches.sketch_columns(orders.where(F.col("o_orderkey").cast("long") % 3 == i)) for i in range(3)]
    merged = sketches.merge_sketches(loads[0].unionByName(loads[1]).unionByName(loads[2]))
    return sketches.settled_profile(orders, merged).select("column_name", "total_values", "null_count", "category", "unique_identifier")


@query(f"""with u as ({unpivoted('part', PART)}), c as (select pos, "column", value, count(*) as n from u where value is not null group by all),
p as (select *, row_number() over (partition by pos order by n desc, value) as place from c) select "column", value, n, place from p where place <= 10""")
def top_values(spark, sf_dir):
    return profile.top_values(_texts(table(spark, sf_dir, "part"), PART))


HEADS = """u as (select pos, "column", value, row_number() over (partition by pos order by o_orderkey) as place from (
 select o_orderkey, 0 as pos, 'o_orderkey' as "column", cast(o_orderkey as varchar) as value from orders union all select o_orderkey, 1, 'o_custkey', cast(o_custkey as varchar) from orders
 union all select o_orderkey, 2, 'o_orderstatus', o_orderstatus from orders union all select o_orderkey, 3, 'o_orderpriority', o_orderpriority from orders)),
i as (select pos, "column", cast(value as bigint) as v, row_number() over (partition by pos order by place) as place from u where regexp_full_match(value, '[+-]?[0-9]+')),
d as (select *, lag(v) over (partition by pos order by place) as w from i),
s as (select pos, "column", count(*) as n, bool_and(w is null or v = w + 1) as stepwise from d group by all)"""


@query("with " + HEADS + """, h as (select pos, "column", bool_and(regexp_full_match(value, '[+-]?[0-9]+')) as num, bool_and(lower(value) in ('true','false','yes','no','1','0','t','f','y','n')) as bool
 from u group by all),
c as (select pos, count(distinct value) as d, count(*) as n from u group by 1),
f as (select h."column", num, bool, num and c.n > 3 and coalesce(stepwise, false) as seq, d / c.n as share, d, c.n from h join c using (pos) left join s using (pos))
select "column", unnest(list_filter([case when num then 'Numeric' end, case when bool then 'Boolean' end, case when seq then 'Sequential' end,
 case when seq or share > 0.95 and n > 10 then 'UniqueIdentifier' end, case when share < 0.1 and d > 1 and d < 50 then 'Category' end], lambda x: x is not null)) as pattern from f""")
def column_patterns(spark, sf_dir):
    return profile.column_patterns(_texts(table(spark, sf_dir, "orders"), ORDERS).withColumn("k", F.col("o_orderkey").cast("long")), ["k"], head=None).where("column != 'k'")


def _pages_sql(close: str, head: str) -> str:
    """Patterns of the pages' columns by their first filled cells: ``head`` of them, Email and Url by the ``close`` ones."""
    return f"""with u as (select *, row_number() over (partition by pos order by k) as place from (select page_id as k, 0 as pos, 'number' as "column", cast(page_id as varchar) as value from pages
 union all select page_id, 1, 'url', url from pages union all select page_id, 2, 'mail', 'p' || page_id || case when page_id % 50 = 49 then '@x.org' else '' end from pages
 union all select page_id, 3, 'flag', case when page_id % 2 = 0 then 'Yes' else 'no' end from pages) where value is not null and trim(value) <> ''),
h as (select * from u where {head}), i as (select *, cast(value as bigint) - lag(cast(value as bigint)) over (partition by pos order by place) as step from h where regexp_full_match(value, '[0-9]+')),
s as (select pos, bool_and(step is null or step = 1) as steps from i group by 1), c as (select pos, count(distinct value) as d, count(*) as n from u group by 1),
f as (select "column", pos, bool_and(regexp_full_match(value, '[0-9]+')) as num, bool_and(lower(value) in ('true','false','yes','no','1','0','t','f','y','n')) as bool,
 bool_or(contains(value, '@') and contains(value, '.')) filter ({close}) as mail, bool_or(starts_with(value, 'http://') or starts_with(value, 'https://')) filter ({close}) as url from h group by all),
g as (select f.*, d, n, num and n > 3 and coalesce(steps, false) as seq from f join c using (pos) left join s using (pos))
select "column", unnest(list_filter([case when num then 'Numeric' end, case when bool then 'Boolean' end, case when mail then 'Email' end, case when url then 'Url' end, case when seq then 'Sequential' end,
 case when seq or d > 0.95 * n and n > 10 then 'UniqueIdentifier' end, case when d < 0.1 * n and d > 1 and d < 50 then 'Category' end], lambda x: x is not null)) as pattern from g"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    mail = F.concat(F.lit("p"), k, F.when(k % 50 == 49, "@x.org").otherwise("")).alias("mail")
    return table(spark, sf_dir, "pages").select(k.cast("string").alias("number"), "url", mail, F.when(k % 2 == 0, "Yes").otherwise("no").alias("flag"), k.alias("k"))


@query(_pages_sql("true", "true"))
def column_patterns_pages(spark, sf_dir):
    """Every pattern, addresses and mail among them, by whole columns."""
    return profile.column_patterns(_pages(spark, sf_dir), ["k"], head=None).where("column != 'k'")


@query(_pages_sql("place <= 20", "place <= 100"))
def column_patterns_head(spark, sf_dir):
    """The same by the first 100 filled cells of a column, and Email and Url by the first 20, as a profile of a head does."""
    return profile.column_patterns(_pages(spark, sf_dir), ["k"], head=100, near=20).where("column != 'k'")


@query("with " + HEADS + """ select "column", n, stepwise from s""")
def column_sequences(spark, sf_dir):
    orders = _texts(table(spark, sf_dir, "orders"), ORDERS).withColumn("k", F.col("o_orderkey").cast("long"))
    return profile.sequences(orders, ["k"], None, ORDERS).drop("pos")


@query("with " + HEADS + """ select "column" from s where stepwise and n > 3""")
def auto_increment(spark, sf_dir):
    orders = _texts(table(spark, sf_dir, "orders"), ORDERS).withColumn("k", F.col("o_orderkey").cast("long"))
    return profile.auto_increment(orders, ["k"], ORDERS, None)


@query("""with h as (select o_orderstatus from orders) select distinct 'o_orderstatus' as "column", o_orderstatus as state from h
where (select count(distinct o_orderstatus) from h) between 2 and 19""")
def status_flows(spark, sf_dir):
    return profile.status_flows(table(spark, sf_dir, "orders"), ["o_orderkey"])


def _relations_sql(source: str, columns: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = " union all ".join(f"select distinct '{a}' as ca, '{b}' as cb, cast({a} as varchar) as a, cast({b} as varchar) as b from {source} where {a} is not null and {b} is not null" for a, b in pairs)
    return f"""with p as ({rows}), x as (select ca, cb, a, count(*) as n from p group by all), y as (select ca, cb, b, count(*) as n from p group by all),
sx as (select ca, cb, count(*) as na, count(*) filter (n > 1) as ma from x group by all), sy as (select ca, cb, count(*) as nb, count(*) filter (n > 1) as mb from y group by all),
s as (select *, ma = 0 and mb = 0 and na > 5 as one, ma / na > 0.5 and nb > na as om, mb / nb > 0.5 and na > nb as mo from sx join sy using (ca, cb))
select ca as column_a, cb as column_b, case when one then 'OneToOne' when om then 'OneToMany' else 'ManyToOne' end as type, round(case when one then 1.0 when om then ma / na else mb / nb end, 6) as strength
from s where one or om or mo"""


RELATED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]


@query(_relations_sql("orders", RELATED))
def column_relations(spark, sf_dir):
    return profile.column_relations(table(spark, sf_dir, "orders").select(*RELATED)).withColumn("strength", F.round("strength", 6))


CATALOGUED = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey"], "nation": ["n_nationkey", "n_name", "n_regionkey"]}


def _frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t).select(*cs) for t, cs in CATALOGUED.items()}


def _pk_sql(c: str, i: int) -> str:
    steps = f" or max({c}) - min({c}) + 1 = count(*) and count(*) > 3" if i == 0 else ""
    return f"((count(distinct {c}) > 0.95 * count(*) and count(*) > 10{steps}) and count(distinct {c}) > 0.9 * count(*))"


def catalogue_sql() -> str:
    """DuckDB SQL: the columns catalogue of CATALOGUED; a key has distinct values for over 95 % of more than 10 cells, or steps by one from the first on."""
    parts = []
    for t, columns in CATALOGUED.items():
        for i, c in enumerate(columns):
            parts.append(f"""select '{t}' as "table", {i} as pos, '{c}' as "column", count(distinct {c}) as unique_count, count(*) - count({c}) as null_count,
 {_pk_sql(c, i)} as is_pk, false as is_fk, count(*) as row_count, 'csv' as source_type from {t}""")
    return " union all ".join(parts)


@query(catalogue_sql())
def profile_catalogue(spark, sf_dir):
    return catalogue.profile_catalogue(_frames(spark, sf_dir), {t: cs[:1] for t, cs in CATALOGUED.items()}, head=None)


@query(f"""select "table", "column" as column_name from ({catalogue_sql()}) where is_pk""")
def pk_candidates(spark, sf_dir):
    out = None
    for t, df in _frames(spark, sf_dir).items():
        part = profile.primary_key_candidates(df, CATALOGUED[t][:1], None).select(F.lit(t).alias("table"), "column_name")
        out = part if out is None else out.unionByName(part)
    return out


@query(" union all ".join(f"""select '{c}' as "column", count(distinct {c}) as unique_count, count(*) - count({c}) as null_count, count({c}) = count(*) and count(distinct {c}) = count(*) as is_key from part""" for c in PART))
def potential_keys(spark, sf_dir):
    return catalogue.potential_keys(_texts(table(spark, sf_dir, "part"), PART))


TYPED = [*PART, "half", "flag", "day"]


@query("""with s as (select max(length(cast(p_partkey as varchar))) as k, max(length(p_name)) as n, max(length(p_brand)) as b, max(length(p_type)) as t, max(length(cast(p_size as varchar))) as z from part)
select 'p_partkey' as "column", case when k <= 3 then 'SmallInt' when k <= 10 then 'Integer' else 'BigInt' end as data_type, cast(null as bigint) as max_length from s
union all select 'p_name', 'VarChar', greatest(n, 50) from s union all select 'p_brand', 'VarChar', greatest(b, 50) from s union all select 'p_type', 'VarChar', greatest(t, 50) from s
union all select 'p_size', 'SmallInt', null from s union all select 'half', 'Float', null union all select 'flag', 'Boolean', null union all select 'day', 'DateTime', null""")
def infer_types(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("half", F.concat("p_size", F.lit(".5"))).withColumn("flag", F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("no"))
    part = part.withColumn("day", F.concat_ws("/", F.lit("2024"), F.lit("01"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")))
    return catalogue.infer_types(_texts(part, TYPED)).withColumn("max_length", F.col("max_length").cast("long"))


@query(f"""with u as (select distinct "column", value from ({unpivoted('part', PART)}) where value is not null), p as (select *, row_number() over (partition by "column" order by value) as pl from u)
select "column", value from p where pl <= 5""")
def sample_values(spark, sf_dir):
    return catalogue.sample_values(_texts(table(spark, sf_dir, "part"), PART))


@query("select o_orderpriority as value, count(*) as n from orders group by 1 order by n desc, value limit 50")
def column_distribution(spark, sf_dir):
    return catalogue.column_distribution(table(spark, sf_dir, "orders"), "O_ORDERPRIORITY")


@query("select s_suppkey as id, s_name as name, s_nationkey from supplier where s_suppkey is not null or s_name is not null")
def import_mapped(spark, sf_dir):
    return files.import_mapped(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), {"s_suppkey": "id", "s_name": "name"})


@query("""with f as (select lower(replace(p_type, ' ', '_')) || '-' || p_brand as field, lower(regexp_replace(p_type || p_brand, '[_ -]', '', 'g')) as bare, p_partkey as pos from part where p_partkey % 3 <> 0),
b as (select bare, arg_min(field, pos) as field from f group by 1)
select p_type || ' ' || p_brand as "column", p_partkey, coalesce(field, '') as field from part left join b on lower(regexp_replace(p_type || p_brand, '[_ -]', '', 'g')) = bare""")
def match_columns(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    fields = part.where(k % 3 != 0).select(F.concat(F.lower(F.regexp_replace("p_type", " ", "_")), F.lit("-"), "p_brand").alias("field"), k.alias("pos"))
    columns = part.select(F.concat_ws(" ", "p_type", "p_brand").alias("column"), k)
    return columns.join(files.match_columns(columns.select("column").distinct(), fields), "column").select("column", "p_partkey", "field")


@query("select c_custkey, c_name from customer order by c_custkey limit 25 offset 50")
def page(spark, sf_dir):
    return files.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 50, 25)


@query("select c_custkey, c_name from customer order by c_custkey limit 10")
def head_rows(spark, sf_dir):
    return files.head_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 10)


@query("select name from (select case when s_suppkey % 3 = 0 then ' ' else s_name end as name from supplier order by s_suppkey limit 20) where trim(name) <> ''")
def sample_column(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").withColumn("name", F.when(F.col("s_suppkey") % 3 == 0, " ").otherwise(F.col("s_name")))
    return files.sample_column(suppliers, "name", ["s_suppkey"], 20)


@query("""select 'customer' as "table", 'c_custkey,c_mktsegment,c_name,c_nationkey' as "columns", count(*) as row_count, 'custkey=c_custkey' as mapping from customer
union all select 'supplier', 's_name,s_nationkey,s_suppkey', count(*), '' from supplier union all select 'nation', 'n_name,n_nationkey,n_regionkey', count(*), '' from nation""")
def schema_catalogue(spark, sf_dir):
    return files.schema_catalogue(_frames(spark, sf_dir), {"customer": {"custkey": "c_custkey"}})


@query("select cast(c_custkey as varchar) as column_1, c_name || ', \"' || c_mktsegment || '\"' as column_2 from customer")
def csv_read(spark, sf_dir):
    path = files.shared_path(spark, "csv")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("x"))
    rows.write.csv(path, quote='"', escape='"')
    return files.read_delimited(spark, path, header=False)


@query("select cast(c_custkey as varchar) as id, c_name as name, c_mktsegment as segment from customer")
def flat_delimited(spark, sf_dir):
    path = files.shared_path(spark, "flat")
    table(spark, sf_dir, "customer").select(F.concat_ws("|", F.col("c_custkey").cast("string"), F.concat(F.lit(" "), "c_name", F.lit("\t")), "c_mktsegment").alias("value")).write.text(path)
    return files.read_flat_delimited(spark, path, "|", ["id", "name", "segment"])


@query("select cast(c_custkey as varchar) as id, c_name as name, c_mktsegment as segment from customer")
def fixed_width(spark, sf_dir):
    path = files.shared_path(spark, "fixed")
    table(spark, sf_dir, "customer").select(F.concat(F.lpad(F.col("c_custkey").cast("string"), 12, " "), F.rpad("c_name", 30, " "), "c_mktsegment").alias("value")).write.text(path)
    return files.read_fixed_width(spark, path, [12, 30, 20], ["id", "name", "segment"])


@query("""select n_name as table_name, 'c' || c_custkey as column_name, cast(c_custkey as int) as ordinal_position,
case when c_custkey % 3 = 0 then 'VarChar(' || (c_custkey % 50 + 1) || ')' when c_custkey % 3 = 1 then 'Integer' else 'DateTime2' end as type, c_custkey % 2 = 0 as nullable,
c_custkey % 10 = 0 as is_pk, c_custkey % 7 = 0 as is_fk from customer join nation on c_nationkey = n_nationkey""")
def information_schema(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("n_name").alias("table_name"), F.concat(F.lit("c"), k).alias("column_name"), k.cast("int").alias("ordinal_position"), k)
    columns = rows.select(
        "table_name", "column_name", "ordinal_position", F.when(k % 3 == 0, "nvarchar").when(k % 3 == 1, "int").otherwise("datetime2").alias("data_type"),
        F.when(k % 3 == 0, (k % 50 + 1) * 2).alias("max_length"), (k % 2 == 0).alias("nullable"),
    )
    pk, fk = F.concat(F.lit("PK_"), "table_name"), F.concat(F.lit("FK_"), "column_name")
    constraints = rows.select(pk.alias("constraint_name"), F.lit("PRIMARY KEY").alias("constraint_type")).distinct()
    constraints = constraints.unionByName(rows.where(k % 7 == 0).select(fk.alias("constraint_name"), F.lit("FOREIGN KEY").alias("constraint_type")))
    usage = rows.where(k % 10 == 0).select(pk.alias("constraint_name"), "table_name", "column_name")
    usage = usage.unionByName(rows.where(k % 7 == 0).select(fk.alias("constraint_name"), "table_name", "column_name"))
    return files.information_schema_columns(columns, constraints, usage)


@query("""with j as (select l.*, o.o_custkey, o.o_orderstatus, o.o_totalprice as l_tax2 from (select l_orderkey, l_partkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint) as cents from lineitem) l
left join orders o on l.l_orderkey = o.o_orderkey)
select l_orderkey as order_no, j.l_partkey, l_linenumber, j.cents, o_custkey, o_orderstatus, p_brand, p_type, p_size as part_cents from j left join part p on j.l_partkey = p.p_partkey""")
def master_record(spark, sf_dir):
    frames = {
        "lineitem": table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")),
        "orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"),
        "part": table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").alias("cents")),
    }
    joins = [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey")]
    return relate.master_record(frames, "lineitem", joins, {"orders": ["o_orderkey"], "part": ["p_partkey"]}, {"l_orderkey": "order_no"})
