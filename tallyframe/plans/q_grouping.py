"""Queries of grouping analysis and packed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import grouping as g
from tallyframe.operators import multivalue as m
from tallyframe.plans.registry import query, table
from tallyframe.sources import files

COLUMNS = ["p_brand_class", "p_type", "size_category", "order_date", "city_code", "amount"]


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("p_brand_class"), "p_type", (F.col("p_size") % 7).cast("string").alias("size_category"),
        F.concat(F.lit("2024-0"), k % 9 + 1).alias("order_date"), F.when(k % 5 != 0, F.concat_ws(" / ", F.concat(F.lit("a"), k % 3), F.concat(F.lit("b"), k % 4))).alias("city_code"),
        (k % 11).cast("string").alias("amount"),
    )


P = """with p as (select p_partkey, p_brand as p_brand_class, p_type, cast(p_size % 7 as varchar) as size_category, '2024-0' || (p_partkey % 9 + 1) as order_date,
case when p_partkey % 5 <> 0 then 'a' || (p_partkey % 3) || ' / b' || (p_partkey % 4) end as city_code, cast(p_partkey % 11 as varchar) as amount from part),
e as (select 0 as pos, 'p_brand_class' as "column", p_brand_class as "group", p_partkey from p union all select 1, 'p_type', p_type, p_partkey from p union all select 2, 'size_category', size_category, p_partkey from p
union all select 3, 'order_date', order_date, p_partkey from p union all select 4, 'city_code', unnest(string_split(city_code, ' / ')), p_partkey from p where city_code is not null union all select 5, 'amount', amount, p_partkey from p),
s as (select pos, "column", "group", count(*) as n from e group by all),
o as (select *, row_number() over (partition by pos order by n) - 1 as pl, count(*) over (partition by pos) as c from s),
d as (select pos, "column", count(*) as group_count, min(n) as min, max(n) as max, round(avg(n), 6) as avg, min(n) filter (pl = c // 2) as median, cast(sum(n) as bigint) as total from o group by all),
t as (select *, case when "column" like '%date%' then 'Temporal' when "column" like '%city%' then 'Geographic' when "column" like '%order%' then 'Identifier' else 'Categorical' end as type from d where group_count <= 1000)
"""


@query(P + "select * from d where group_count between 1 and 1000")
def group_dimensions(spark, sf_dir):
    return g.grouping_dimensions(_parts(spark, sf_dir).drop("p_partkey")).withColumn("avg", F.round("avg", 6))


@query(P + """, r as (select *, row_number() over (partition by pos order by n desc, "group") as place from s), x as (select distinct r."column", r."group", r.n, e.p_partkey from r join e on r.pos = e.pos and r."group" = e."group" where place <= 5),
y as (select *, row_number() over (partition by "column", "group" order by p_partkey) as pl from x)
select "column", "group", n, string_agg(cast(p_partkey as varchar), ',' order by p_partkey) as rows from y where pl <= 3 group by all""")
def group_examples(spark, sf_dir):
    return g.group_examples(_parts(spark, sf_dir), "p_partkey")


@query(P + """select "column", type from t""")
def dimension_types(spark, sf_dir):
    return g.typed_dimensions(_parts(spark, sf_dir).drop("p_partkey")).select("column", "type")


@query(P + """select "column", group_count as groups, total as records, case when max > 3 * avg then 'uneven' else 'even' end as distribution,
case type when 'Temporal' then 'trend' when 'Identifier' then 'per_entity' when 'Categorical' then 'compare' else 'regional' end as kind from t""")
def insights(spark, sf_dir):
    return g.dimension_insights(g.typed_dimensions(_parts(spark, sf_dir).drop("p_partkey")))


@query(P + """, v as (select string_agg("column", ',' order by pos) as levels, count(*) as n from (select pos, "column" from t where type = 'Temporal' union all select 6, 'ship_month' from t where pos = 0)) select levels from v where n >= 2""")
def temporal_hierarchy(spark, sf_dir):
    parts = _parts(spark, sf_dir).drop("p_partkey").withColumn("ship_month", F.col("size_category"))
    return g.temporal_hierarchy(g.typed_dimensions(parts))


@query(P + """, q as (select 'p_brand_class' as parent, 'p_type' as child, p_brand_class as a, p_type as b from p union all select 'p_brand_class', 'size_category', p_brand_class, size_category from p union all select 'p_type', 'size_category', p_type, size_category from p),
n as (select parent, child, a, count(distinct b) as n from q group by all) select parent, child, round(avg(n), 6) as mean_children from n group by all having avg(n) > 1.5""")
def categorical_hierarchy(spark, sf_dir):
    return g.categorical_hierarchy(_parts(spark, sf_dir)).withColumn("mean_children", F.round("mean_children", 6))


@query(P + """select "column" as dimension, unnest(case type when 'Temporal' then ['trend', 'sum_average'] when 'Identifier' then ['per_entity', 'frequency'] when 'Categorical' then ['compare', 'average'] else ['regional'] end) as kind,
unnest(case type when 'Temporal' then [null, 'amount'] when 'Identifier' then [null, null] when 'Categorical' then [null, 'amount'] else [null] end) as measure from t
union all select string_agg("column", ' x ' order by pos), 'cross', null from (select * from t order by pos limit 2)""")
def suggestions(spark, sf_dir):
    parts = _parts(spark, sf_dir).drop("p_partkey")
    return g.suggested_analyses(g.typed_dimensions(parts), parts.columns)


@query("""with k as (select p_partkey, lower(unnest(['X' || p_size % 3, p_brand])) as group_key from part) select group_key, group_key as file_name, count(*) as rows from k group by 1""")
def group_keys(spark, sf_dir):
    cell = F.concat_ws(";", F.concat(F.lit(" X"), F.col("p_size") % 3, F.lit(" ")), "p_brand", F.lit(" "), "p_brand")
    return g.group_summary(table(spark, sf_dir, "part"), g.group_keys(cell, ";"))


@query("select p_partkey, p_type, lower(p_brand) as group_key from part")
def grouped_sink(spark, sf_dir):
    path = files.shared_path(spark, "grouped")
    files.write_grouped(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), g.group_keys(F.col("p_brand")), path)
    return spark.read.parquet(path).select("p_partkey", "p_type", F.col("group_key").cast("string").alias("group_key"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their parts' numbers packed in a cell, and texts of documents."""
    k = F.col("o_orderkey")
    packed = F.when(k % 4 == 0, F.concat(F.lit("solo"), k)).otherwise(F.concat_ws("; ", F.concat(F.lit("part"), k % 50), F.concat(F.lit("item"), k % 20), F.lit("spare")))
    return table(spark, sf_dir, "orders").select("o_orderkey", packed.alias("packed"), "o_orderpriority")


D = """with o as (select o_orderkey, case when o_orderkey % 4 = 0 then 'solo' || o_orderkey else 'part' || (o_orderkey % 50) || '; item' || (o_orderkey % 20) || '; spare' end as packed, o_orderpriority from orders)
"""


@query("""with s as (select avg(contains(text, ',')::int) as a, avg(contains(text, ';')::int) as b, avg(contains(text, '|')::int) as c, avg(contains(text, chr(9))::int) as d, avg(contains(text, chr(10))::int) as e,
avg(((regexp_matches(text, '/.*/') or regexp_matches(text, '-.*-')) and regexp_matches(text, '[0-9]'))::int) as dates from documents where trim(text) <> '')
select 'text' as "column", case greatest(a, b, c, d, e) when a then ',' when b then ';' when c then '|' when d then chr(9) else chr(10) end as delimiter, round(greatest(a, b, c, d, e), 6) as share from s where dates <= 0.8""")
def mv_delimiter(spark, sf_dir):
    return m.detect_delimiter(table(spark, sf_dir, "documents").select("text")).withColumn("share", F.round("share", 6))


@query(D + """, s as (select count(*) as total_count, count(*) filter (contains(packed, ';')) as multi_value_count, avg(len(string_split(packed, ';'))) as parts from o),
a as (select count(distinct trim(x)) as atoms from (select unnest(string_split(packed, ';')) as x from o))
select 'packed' as "column", 'Delimited' as method, ';' as delimiter, round(multi_value_count / total_count * case when abs(parts - 2) < 0.5 then 0.5 else 1 end, 6) as confidence, total_count, multi_value_count,
round(multi_value_count / total_count, 6) as ratio, atoms from s, a""")
def mv_report(spark, sf_dir):
    found = m.delimited_report(_packed(spark, sf_dir).select("packed"))
    return found.withColumn("confidence", F.round("confidence", 6)).withColumn("ratio", F.round("ratio", 6))


@query(D + "select o_orderkey, trim(unnest(string_split(packed, ';'))) as atom from o")
def mv_split(spark, sf_dir):
    return m.split_values(_packed(spark, sf_dir), "packed", ";").select("o_orderkey", "atom")


@query("""with c as (select case when o_orderkey % 3 = 0 then 'ABCD' || lpad(cast(o_orderkey % 10000 as varchar), 4, '0') || 'WXYZ' || lpad(cast(o_orderkey % 10000 as varchar), 4, '0') else 'ABCD' || lpad(cast(o_orderkey % 10000 as varchar), 4, '0') end as code from orders),
s as (select count(*) as total_count, count(*) filter (length(code) = 16) as multi_value_count from c)
select 'code' as "column", 'PatternRepetition' as method, total_count, multi_value_count, round(0.6 * multi_value_count / total_count, 6) as confidence from s""")
def mv_pattern(spark, sf_dir):
    k = F.col("o_orderkey")
    four = F.lpad((k % 10000).cast("string"), 4, "0")
    code = F.when(k % 3 == 0, F.concat(F.lit("ABCD"), four, F.lit("WXYZ"), four)).otherwise(F.concat(F.lit("ABCD"), four))
    found = m.pattern_repetition_report(table(spark, sf_dir, "orders").select(code.alias("code")))
    return found.select("column", "method", "total_count", "multi_value_count", F.round("confidence", 6).alias("confidence"))


@query("""with l as (select strlen(text) as b from documents where trim(text) <> ''), c as (select quantile_cont(b, 0.5) as med from l), d as (select quantile_cont(abs(b - med), 0.5) as mad from l, c),
s as (select count(*) as total_count, count(*) filter (0.6745 * abs(b - med) / mad > 3.5 and b > med) as multi_value_count from l, c, d where mad > 0)
select 'text' as "column", 'LengthOutlier' as method, total_count, multi_value_count, round(0.4 * multi_value_count / total_count, 6) as confidence from s where multi_value_count >= 2""")
def mv_outlier(spark, sf_dir):
    found = m.length_outlier_report(table(spark, sf_dir, "documents").select("text"))
    return found.select("column", "method", "total_count", "multi_value_count", F.round("confidence", 6).alias("confidence"))


def findings_sql(cells: str) -> str:
    """``found``: the first finding of every column of ``cells`` ("table", "column", v), by the four methods in their order.

    A cell is segmented if its runs of letters with digits are all words, which says the same where no word starts another.
    """
    at = '"table", "column"'
    return f"""cells as (select * from ({cells}) where trim(v) <> ''),
sh as (select {at}, d, count(*) as n, avg(contains(v, d)::int) as share, avg(((regexp_matches(v, '/.*/') or regexp_matches(v, '-.*-')) and regexp_matches(v, '[0-9]'))::int) as dates
from cells, (values (0, ','), (1, ';'), (2, '|'), (3, chr(9)), (4, chr(10))) t(i, d) group by {at}, d, i qualify row_number() over (partition by {at} order by share desc, i) = 1),
pa as (select {at}, d, share, v, string_split(v, d) as raw, list_filter(list_transform(string_split(v, d), lambda x: trim(x)), lambda x: x <> '') as parts from cells join sh using ({at}) where n >= 5 and dates <= 0.8 and share > 0.2),
words as (select distinct w from (select unnest(parts) as w from pa) where strlen(w) >= 3),
de as (select {at}, 0 as priority, 'Delimited' as method, count(*) as total_count, count(*) filter (contains(v, d)) as multi_value_count, share * case when abs(avg(len(raw)) - 2) < 0.5 then 0.5 else 1 end
* case when sum(len(list_filter(parts, lambda x: try_cast(replace(x, ',', '') as double) is not null))) > 0.5 * sum(len(parts)) then 0.1 else 1 end as confidence from pa group by {at}, share),
ru as (select {at}, v, count(*) as n, regexp_extract_all(v, '[a-z]+[0-9]*') as runs from cells group by {at}, v),
se as (select {at}, v from (select {at}, v, len(runs) as n, unnest(runs) as w from ru where len(runs) >= 2 and array_to_string(runs, '') = v and strlen(v) <= 500) join words using (w) group by {at}, v, n having count(*) = n),
vo as (select {at}, 1, 'VocabularySegmented', sum(ru.n)::bigint as total_count, coalesce(sum(ru.n) filter (se.v is not null), 0)::bigint as multi_value_count, least(1.5 * multi_value_count / total_count, 0.95) from ru left join se using ({at}, v)
where (select count(*) from words) >= 5 group by {at} having multi_value_count >= 0.1 * total_count),
sp as (select {at}, regexp_replace(regexp_replace(regexp_replace(v, '\\p{{Lu}}', 'U', 'g'), '\\p{{Ll}}', 'l', 'g'), '[0-9]', 'd', 'g') as shape from cells),
mo as (select {at}, shape as modal from (select {at}, shape, count(*) as n from sp group by all) qualify row_number() over (partition by {at} order by n desc, shape) = 1),
re as (select {at}, 2, 'PatternRepetition', count(*) as total_count, count(*) filter (strlen(shape) >= 2 * strlen(modal) and (length(shape) - length(replace(shape, modal, ''))) // length(modal) >= 2) as multi_value_count,
0.6 * multi_value_count / total_count from sp join mo using ({at}) where strlen(modal) >= 3 group by {at} having multi_value_count > 0.1 * total_count),
me as (select {at}, strlen(v) as b, quantile_cont(strlen(v), 0.5) over (partition by {at}) as med from cells), ma as (select *, quantile_cont(abs(b - med), 0.5) over (partition by {at}) as mad from me),
ou as (select {at}, 3, 'LengthOutlier', count(*) as total_count, count(*) filter (0.6745 * abs(b - med) / mad > 3.5 and b > med) as multi_value_count, 0.4 * multi_value_count / total_count from ma where mad > 0 group by {at} having multi_value_count >= 2),
found as (select * from (select * from de union all select * from vo union all select * from re union all select * from ou) qualify row_number() over (partition by {at} order by priority) = 1)
"""


#: The kept findings of ``findings_sql``: a column whose delimiter is doubtful has none.
KEPT = "found where method <> 'Delimited' or confidence >= 0.2"
CELLS = {
    "packed": "packed",
    "joined": "case when o_orderkey % 4 = 1 then 'part' || o_orderkey % 50 || 'item' || o_orderkey % 20 else 'none' || o_orderkey % 9 end",
    "code": "'ABCD' || lpad('' || o_orderkey % 10000, 4, '0') || case when o_orderkey % 3 = 0 then 'WXYZ' || lpad('' || o_orderkey % 10000, 4, '0') else '' end",
    "note": "case when o_orderkey % 25 = 0 then repeat('%', 400) else left('?!:*+~=', o_orderkey % 7 + 1) end",
    "o_orderpriority": "o_orderpriority",
}


@query(D + ", " + findings_sql(" union all ".join(f"""select 'orders' as "table", '{n}' as "column", {v} as v from o""" for n, v in CELLS.items())) + f"""select "table", "column", method, total_count, multi_value_count, round(confidence, 6) as confidence from {KEPT}""")
def mv_cascade(spark, sf_dir):
    frame = _packed(spark, sf_dir).select(*(F.expr(v).alias(n) for n, v in CELLS.items()))
    return m.detect_multi_value({"orders": frame}).select("table", "column", "method", "total_count", "multi_value_count", F.round("confidence", 6).alias("confidence"))


@query(D + "select distinct trim(x) as atom from (select unnest(string_split(packed, ';')) as x from o) where strlen(trim(x)) >= 3")
def mv_vocabulary(spark, sf_dir):
    return m.vocabulary(_packed(spark, sf_dir), "packed", ";")


@query("""select p_partkey, lower(p_brand) || '+' || lower(replace(p_type, ' ', '')) as parts from part""")
def mv_segment(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    brand, kind = F.lower("p_brand"), F.lower(F.regexp_replace("p_type", " ", ""))
    words = part.select(F.explode(F.array(brand, kind)).alias("atom")).distinct()
    packed = part.select("p_partkey", F.concat(brand, kind).alias("value"))
    return packed.join(m.segments(packed, words), "value", "left").select("p_partkey", F.array_join("parts", "+").alias("parts"))


@query("""with s as (select count(*) as total_count, count(*) filter (p_partkey % 4 = 0) as multi_value_count from part)
select 'packed' as "column", 'VocabularySegmented' as method, total_count, multi_value_count, round(least(1.5 * multi_value_count / total_count, 0.95), 6) as confidence from s""")
def mv_segment_report(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    brand, kind = F.lower("p_brand"), F.lower(F.regexp_replace("p_type", " ", ""))
    words = part.select(F.explode(F.array(brand, kind)).alias("atom")).distinct()
    found = m.vocabulary_segmented_report(part.select(F.when(F.col("p_partkey") % 4 == 0, F.concat(brand, kind)).otherwise(F.concat(F.lit("?"), kind)).alias("packed")), words)
    return found.select("column", "method", "total_count", "multi_value_count", F.round("confidence", 6).alias("confidence"))
