"""Queries of checks: aggregates, predicates, assertions, roll-ups, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import predicates as p
from tallyframe.operators import checks as c
from tallyframe.plans.registry import query, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("long").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.nullif(F.col("l_linenumber"), F.lit(5)).alias("line"), F.nullif("l_returnflag", F.lit("R")).alias("flag"),
    )


L = """with l as (select *, cast(l_quantity as bigint) as qty, cast(round(l_extendedprice * 100) as bigint) as cents, nullif(l_linenumber, 5) as line, nullif(l_returnflag, 'R') as flag from lineitem)
"""


@query(L + """select cast(sum(cents) as bigint) as sum_cents, cast(coalesce(sum(cents) filter (flag = 'N'), 0) as bigint) as sum_n, cast(coalesce(sum(cents) filter (flag = 'Z'), 0) as bigint) as sum_none,
round(sum(qty) / count(qty), 6) as avg_qty, count(line) as n_line, cast(min(line) as int) as min_line, cast(max(line) filter (flag = 'A') as int) as max_line_a from l""")
def check_aggs(spark, sf_dir):
    cents, qty, line, flag = map(F.col, ("cents", "qty", "line", "flag"))
    return _lines(spark, sf_dir).agg(
        c.check_sum(cents).alias("sum_cents"), c.check_sum(cents, flag == "N").alias("sum_n"), c.check_sum(cents, flag == "Z").alias("sum_none"),
        F.round(c.check_avg(qty).cast("double"), 6).alias("avg_qty"), c.check_count(line).alias("n_line"), c.check_min(line).alias("min_line"),
        c.check_max(line, flag == "A").alias("max_line_a"),
    )


@query(L + """select count(flag) as n_flag, count(*) filter (flag = 'N') as n_n, cast(sum(line) filter (line = 3) as bigint) as sum_3, cast(sum(cents) filter (line = 3) as bigint) as cents_3, cast(sum(line) as bigint) as sum_line from l""")
def check_countif_sumif(spark, sf_dir):
    line, flag = F.col("line"), F.col("flag")
    return _lines(spark, sf_dir).agg(
        c.countif(flag).alias("n_flag"), c.countif(flag, F.lit("N")).alias("n_n"), c.sumif(line, F.lit(3)).alias("sum_3"),
        c.sumif(line, F.lit(3), F.col("cents")).alias("cents_3"), c.sumif(line).alias("sum_line"),
    )


@query(L + """select cast(sum(distinct line) as bigint) as s, count(distinct flag) as n, round(avg(distinct qty), 6) as a from l""")
def check_distinct(spark, sf_dir):
    return _lines(spark, sf_dir).agg(
        c.check_sum(F.col("line"), distinct=True).alias("s"), c.check_count(F.col("flag"), distinct=True).alias("n"), F.round(c.check_avg(F.col("qty"), distinct=True).cast("double"), 6).alias("a")
    )


@query(L + """select l_orderkey, l_linenumber, cents from l where 3 * cents > 4 * (select avg(cents) from l) + (select count(*) from part) - (select count(*) from orders)""")
def check_subquery(spark, sf_dir):
    lines = c.with_scalars(_lines(spark, sf_dir), _lines(spark, sf_dir), mean=F.avg("cents"))
    lines = c.with_scalars(lines, table(spark, sf_dir, "part"), parts=F.count("*"))
    lines = c.with_scalars(lines, table(spark, sf_dir, "orders"), orders=F.count("*"))
    return lines.where(p.gt(3 * F.col("cents"), 4 * F.col("mean") + F.col("parts") - F.col("orders"))).select("l_orderkey", "l_linenumber", "cents")


@query(L + """select l_orderkey, l_linenumber, coalesce(line = 3, false) as eq, not coalesce(line = 3, false) as ne, coalesce(line > 3, false) as gt, coalesce(line <= 3, false) as le, not coalesce(line < 3, false) as not_lt,
coalesce(line >= 2, false) and coalesce(flag = 'N', false) as both, coalesce(line >= 4, false) or coalesce(flag = 'A', false) as either, line is null as blank,
coalesce(line, 0) + qty as plus, coalesce(line, 0) * 2 - qty as minus, -coalesce(line, 0) as neg, nullif(l_linenumber, 2) as no_two from l""")
def predicates_2vl(spark, sf_dir):
    line, flag, qty = F.col("line"), F.col("flag"), F.col("qty")
    return _lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", p.eq(line, F.lit(3)).alias("eq"), p.ne(line, F.lit(3)).alias("ne"), p.gt(line, F.lit(3)).alias("gt"), p.le(line, F.lit(3)).alias("le"),
        p.not_(line < 3).alias("not_lt"), p.and_(line >= 2, flag == "N").alias("both"), p.or_(line >= 4, flag == "A").alias("either"), p.is_null(line).alias("blank"),
        p.add(line, qty).alias("plus"), p.sub(p.mul(line, F.lit(2)), qty).alias("minus"), p.neg(line).alias("neg"), p.nullif_(F.col("l_linenumber"), F.lit(2)).alias("no_two"),
    )


@query(L + """select l_orderkey, l_linenumber, case when line > 4 then 'high' when line > 2 then 'mid' end as band, case when flag = 'N' then 'new' else 'old' end as age, coalesce(flag, l_returnflag) as any_flag,
round(case when line is null or line = 0 then null else qty / line end, 6) as share from l""")
def case_iif(spark, sf_dir):
    line, flag = F.col("line"), F.col("flag")
    return _lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", p.case_when([(line > 4, F.lit("high")), (line > 2, F.lit("mid"))]).alias("band"), p.iif(flag == "N", F.lit("new"), F.lit("old")).alias("age"),
        p.coalesce_(flag, F.col("l_returnflag")).alias("any_flag"), F.round(p.div(F.col("qty"), line, excluding=True), 6).alias("share"),
    )


@query("""select p_partkey, coalesce(p_type, '') ilike '%standard%' as std, not (coalesce(p_name, '') ilike 'p_r%') as other from part""")
def like_ci(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", p.like(p.ref(part, "part.P_Type"), "%standard%").alias("std"), p.like(p.ref(part, "p_name"), "P_R%", negated=True).alias("other"))


@query(L + """select l_orderkey, l_linenumber, coalesce(line between 2 and 4, false) as between_, not coalesce(line between 2 and 4, false) as outside, coalesce(line in (1, 3), false) as in_, not coalesce(line in (1, 3), false) as not_in from l""")
def between_in(spark, sf_dir):
    line = F.col("line")
    return _lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", p.between(line, F.lit(2), F.lit(4)).alias("between_"), p.between(line, F.lit(2), F.lit(4), negated=True).alias("outside"),
        p.in_list(line, [1, 3]).alias("in_"), p.in_list(line, [1, 3], negated=True).alias("not_in"),
    )


@query("""select p_partkey, case when p_size % 3 = 0 then null when p_size % 3 = 1 then cast(p_size as double) end as num, case when p_size % 3 = 2 then p_brand end as txt from part""")
def typed_cells(spark, sf_dir):
    size = F.col("p_size")
    raw = F.when(size % 3 == 0, "  ").when(size % 3 == 1, F.concat(F.lit(" "), size.cast("string"))).otherwise(F.col("p_brand"))
    number, text = p.typed(raw)
    return table(spark, sf_dir, "part").select("p_partkey", number.cast("double").alias("num"), text.alias("txt"))


def _checks() -> list[c.Check]:
    return [
        c.Check("rows", "lineitem", c.check_count(F.col("l_orderkey")), ">", F.lit(0)),
        c.Check("sum", "lineitem", c.check_sum(F.col("cents")), "=", c.check_sum(F.col("cents"), F.col("l_returnflag").isNotNull())),
        c.Check("max line", "lineitem", c.check_max(F.col("l_linenumber")), "<=", F.lit(3), source_col="l_linenumber"),
        c.Check("quantity", "lineitem", predicate=p.between(F.col("qty"), F.lit(1), F.lit(40)), source_col="qty"),
        c.Check("broken", "lineitem", c.check_sum(F.col("no_such")), ">", F.lit(0)),
        c.Check("nowhere", "missing", c.check_sum(F.col("cents")), ">", F.lit(0)),
    ]


R = L + """, r as (select 'rows' as label, count(l_orderkey) > 0 as passed, cast(count(l_orderkey) as varchar) as lhs_value, '>' as op, '0' as rhs_value, cast(null as varchar) as source_col, false as failed from l
union all select 'sum', sum(cents) = sum(cents), cast(sum(cents) as varchar), '=', cast(sum(cents) as varchar), null, false from l
union all select 'max line', max(l_linenumber) <= 3, cast(max(l_linenumber) as varchar), '<=', '3', 'l_linenumber', false from l
union all select 'quantity', count(*) filter (qty between 1 and 40) = count(*), cast(count(*) filter (qty between 1 and 40) as varchar), '/', cast(count(*) as varchar), 'qty', false from l
union all select 'broken', null, null, null, null, null, true union all select 'nowhere', null, null, null, null, null, true)
"""


@query(R + "select label, passed, lhs_value, op, rhs_value, source_col, failed as is_error from r")
def run_checks(spark, sf_dir):
    found = c.run_checks({"lineitem": _lines(spark, sf_dir)}, _checks())
    return found.withColumn("is_error", F.col("error").isNotNull()).drop("error")


@query(L + "select 'total' as label, sum(cents) > 1000 as passed, cast(sum(cents) as varchar) as lhs_value, '>' as op, '1000' as rhs_value, 'cents' as source_col from l")
def assert_values(spark, sf_dir):
    return c.assert_value(_lines(spark, sf_dir), c.Check("total", "lineitem", c.check_sum(F.col("cents")), ">", F.lit(1000), source_col="cents"))


@query(L + "select 'line set' as label, count(line) = count(*) as passed, cast(count(line) as varchar) as lhs_value, '/' as op, cast(count(*) as varchar) as rhs_value, 'line' as source_col from l")
def assert_rows(spark, sf_dir):
    return c.assert_rows(_lines(spark, sf_dir), p.is_not_null(F.col("line")), "line set", "line")


@query(L + "select l_orderkey, l_linenumber, cents from l where not coalesce(flag = 'N' and line < 4, false)")
def failing_rows(spark, sf_dir):
    return c.failing_rows(_lines(spark, sf_dir), (F.col("flag") == "N") & (F.col("line") < 4)).select("l_orderkey", "l_linenumber", "cents")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of every customer's orders as results of a script for each nation."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return customers.select(
        F.col("n_name").alias("script"), k.alias("pos"), F.concat(F.lit("check "), k).alias("label"),
        F.when((k % 13 != 0) & (k % 17 != 0), (k % 19 != 0) | (F.col("n_regionkey") == 2)).alias("passed"), F.when(k % 17 == 0, "no such column").alias("error"),
        F.when(k % 13 == 0, k.cast("string")).alias("lhs_value"), F.lit("c_mktsegment").alias("source_col"),
    )


X = """with r as (select n_name as script, n_regionkey as region, c_custkey as pos, 'check ' || c_custkey as label, case when c_custkey % 13 <> 0 and c_custkey % 17 <> 0 then c_custkey % 19 <> 0 or n_regionkey = 2 end as passed,
case when c_custkey % 17 = 0 then 'no such column' end as error, case when c_custkey % 13 = 0 then cast(c_custkey as varchar) end as lhs_value from customer join nation on c_nationkey = n_nationkey)
"""


@query(X + """, s as (select script, count(*) filter (passed) as passed, count(*) filter (not passed and error is null) as failed, count(error) as errors from r group by 1)
select * from s union all select null, cast(sum(passed) as bigint), cast(sum(failed) as bigint), cast(sum(errors) as bigint) from s""")
def check_rollup(spark, sf_dir):
    return c.check_rollup(_results(spark, sf_dir))


@query(X + """, k as (select *, case when error is not null then 'e' when passed is not null then 'a' else 'v' end as kind from r)
select script, coalesce(arg_min(case when passed then 'passed' else 'failed' end, pos) filter (kind = 'a'), arg_min('error: ' || error, pos) filter (kind = 'e'), arg_min('value: ' || coalesce(lhs_value, ''), pos) filter (kind = 'v')) as outcome,
count(*) filter (kind = 'a' and not passed) as exceptions from k group by 1""")
def script_outcome(spark, sf_dir):
    return c.script_outcome(_results(spark, sf_dir))


def _scripts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, sf_dir, "nation")
    scripts = nations.select(F.col("n_name").alias("script"), F.concat(F.lit("C-"), "n_regionkey").alias("ref"))
    regions = table(spark, sf_dir, "region")
    controls = regions.select(F.concat(F.lit("C-"), "r_regionkey").alias("ref"), F.col("r_name").alias("objective"), F.when(F.col("r_regionkey") % 2 == 0, "High").alias("risk"))
    return scripts, controls


@query(X + """, b as (select script, region, string_agg(label, '; ' order by label) as failing from r where passed = false or error is not null group by 1, 2)
select script, 'C-' || region as ref, r_name as objective, case when region % 2 = 0 then 'High' else 'Medium' end as risk, failing from b join region on r_regionkey = region""")
def findings(spark, sf_dir):
    scripts, controls = _scripts(spark, sf_dir)
    return c.findings(scripts, _results(spark, sf_dir), controls)


@query(X + """, b as (select distinct script from r where passed = false or error is not null) select distinct 'C-' || n_regionkey as ref from nation where n_name not in (select script from b)""")
def passed_refs(spark, sf_dir):
    return c.passed_refs(_scripts(spark, sf_dir)[0], _results(spark, sf_dir))


@query("""select 'c_mktsegment' as "column", c_mktsegment as value, count(*) as n from customer group by 2 order by n desc, value limit 50""")
def evidence(spark, sf_dir):
    return c.evidence_distribution(_results(spark, sf_dir), table(spark, sf_dir, "customer"), ["c_mktsegment", "c_name"])


@query("""select c_custkey, c_name as process, coalesce(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey), '') as controls, count(o_orderkey) as n,
coalesce(first(o_orderpriority order by o_orderkey), c_name) as title from customer left join orders on o_custkey = c_custkey group by c_custkey, c_name""")
def nested_plan(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("key"), F.col("c_name").alias("process"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_orderkey").cast("string").alias("ref"), "o_orderpriority")
    found = c.nest(customers, orders, "key", "o_orderkey", "controls")
    title = c.group_title(F.get(F.col("controls.o_orderpriority"), F.lit(0)), F.lit(" "), F.col("process"))
    return found.select("c_custkey", "process", F.array_join("controls.ref", ",").alias("controls"), F.size("controls").cast("long").alias("n"), title.alias("title"))


@query("""with i as (select o_orderpriority as control, o_orderstatus = 'F' as approved, case when o_orderkey % 2 = 0 then 'SQL' else 'CSV' end as item_type from orders),
s as (select control, count(*) as total, count(*) filter (approved) as approved, count(*) filter (item_type = 'SQL') as sql_items, count(*) filter (item_type = 'CSV') as csv_items from i group by 1)
select * from s union all select null, cast(sum(total) as bigint), cast(sum(approved) as bigint), cast(sum(sql_items) as bigint), cast(sum(csv_items) as bigint) from s""")
def approval_rollup(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("control"), (F.col("o_orderstatus") == "F").alias("approved"), F.when(F.col("o_orderkey") % 2 == 0, "SQL").otherwise("csv").alias("item_type")
    )
    return c.approval_rollup(items)
