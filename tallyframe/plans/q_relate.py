"""Queries of relationship and workflow detection, and of the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import catalogue, multivalue, reconcile
from tallyframe.operators import relate as r
from tallyframe.plans import report
from tallyframe.plans.q_grouping import KEPT, findings_sql
from tallyframe.plans.q_profile import _pk_sql
from tallyframe.plans.registry import query, table

#: Tables as they would be registered: name, columns of a test table under other names.
SHAPES = {
    "customer": ("customer", {"c_custkey": "id", "c_name": "customer_name", "c_nationkey": "NationKey", "c_mktsegment": "segment"}),
    "nation": ("nation", {"n_nationkey": "nation_key", "n_name": "nation_name", "n_regionkey": "RegionId"}),
    "region": ("region", {"r_regionkey": "id", "r_name": "region_name"}),
    "stg_customer": ("customer", {"c_custkey": "id", "c_name": "customer_name", "c_mktsegment": "segment"}),
    "sales_summary": ("orders", {"o_orderkey": "sales_key", "o_custkey": "customer_id", "o_orderstatus": "segment"}),
    "dim_part": ("part", {"p_partkey": "part_no", "p_brand": "brand", "p_size": "size"}),
    "supplier_region": ("supplier", {"s_suppkey": "supplier_no", "s_nationkey": "region_name"}),
    "nation_region": ("nation", {"n_nationkey": "nation_no", "n_name": "region_name"}),
}


def _frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, t).select(*(F.col(a).alias(b) for a, b in cs.items())) for n, (t, cs) in SHAPES.items()}


def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frames = _frames(spark, sf_dir)
    columns = catalogue.profile_catalogue(frames, {n: list(cs.values())[:1] for n, (_, cs) in SHAPES.items()}, "mssql", head=None)
    # Foreign keys as a database would declare them: key-like names that aren't their table's own key.
    columns = columns.withColumn("is_fk", F.lower("column").rlike("(id|key)$") & ~F.col("is_pk") & (F.length("column") > 3))
    tables = columns.groupBy("table").agg(F.max("row_count").alias("row_count")).join(report.sources_order(spark, list(SHAPES)), "table")
    return columns, tables.withColumn("source_type", F.lit("mssql"))


def _catalogue_sql(names: list[str] = list(SHAPES), declared: bool = True) -> str:
    rows = []
    for t in names:
        source, cs = SHAPES[t]
        for i, (a, b) in enumerate(cs.items()):
            rows.append(f"""select '{t}' as "table", {list(SHAPES).index(t)} as tpos, {i} as pos, '{b}' as "column", count(distinct {a}) as unique_count, count(*) as row_count,
 {_pk_sql(a, i)} as is_pk from {source}""")
    return "with c as (" + " union all ".join(rows) + f"""), cat as (select *, {str(declared).lower()} and regexp_matches(lower("column"), '(id|key)$') and not is_pk and length("column") > 3 as is_fk from c)
"""


C = _catalogue_sql()
STEM = """, st as (select "table", tpos, lower(replace("table", '_', '')) as bare from (select distinct "table", tpos from cat))
"""


FK = """, f as (select cat."table" as ft, "column" as fc, case when lower("column") like '%id' then left("column", length("column") - 2) else left("column", length("column") - 3) end as stem from cat where is_fk),
g as (select ft, fc, st."table" as tt, row_number() over (partition by ft, fc order by st.tpos) as pl from f join st on starts_with(bare, lower(replace(stem, '_', ''))) and st."table" <> ft and replace(stem, '_', '') <> ''),
fk as (select ft as from_table, fc as from_column, tt as to_table, case when lower(fc) like '%id' then 'Id' else 'Key' end as to_column, 'ForeignKey' as kind, 95 as confidence from g where pl = 1)
"""


@query(C + STEM + FK + "select * from fk")
def fk_explicit(spark, sf_dir):
    return r.explicit_fk(*_catalogue(spark, sf_dir))


MATCHES = """, k as (select *, lower("column") as name, lower("column") like '%id' or is_pk or unique_count = row_count and row_count > 0 as key from cat),
n as (select name, count(*) filter (key) as keys, count(*) as n from k group by 1 having count(*) > 1), q as (select k.*, n.keys, n.n from k join n using (name)),
nm as (select a."table" as from_table, a."column" as from_column, b."table" as to_table, b."column" as to_column, 'NameMatch' as kind, case when a.keys > 0 and a.keys < a.n then 85 when a.keys > 0 then 80 else 60 end as confidence
from q a join q b on a.name = b.name and a."table" <> b."table" where case when a.keys > 0 and a.keys < a.n then not a.key and b.key else a.tpos < b.tpos end)
"""


NAMES = C + MATCHES


@query(NAMES + "select * from nm")
def name_match(spark, sf_dir):
    return r.name_match(*_catalogue(spark, sf_dir))


PATTERNS = """, o as (select * from (values (0, 'id', 'id'), (1, '_id', 'id'), (2, 'key', 'key'), (3, '_key', 'key'), (4, '_pk', 'id')) t(rank, suffix, target)),
a as (select cat."table" as ft, "column" as fc, rank, target, left("column", length("column") - length(suffix)) as stem from cat, o where lower("column") like '%' || replace(suffix, '_', '\\_') escape '\\' and length("column") > length(suffix)),
b as (select a.*, st."table" as tt, row_number() over (partition by ft, fc, stem order by st.tpos) as pl from a join st on starts_with(bare, lower(replace(stem, '_', ''))) and st."table" <> ft and replace(stem, '_', '') <> ''),
d as (select b.ft, b.fc, b.tt, cat."column" as tc, row_number() over (partition by ft, fc order by rank, cat.pos) as place from b join cat on cat."table" = b.tt and (lower(cat."column") = target or lower(cat."column") = lower(stem || '_' || target)) where pl = 1),
pm as (select ft as from_table, fc as from_column, tt as to_table, tc as to_column, 'NameMatch' as kind, 70 as confidence from d where place = 1)
"""


@query(C + STEM + PATTERNS + "select * from pm")
def pattern_match(spark, sf_dir):
    return r.pattern_match(*_catalogue(spark, sf_dir))


EVERY = """, known as (select * from fk union all select * from nm),
united as (select * from known union all select * from pm where not exists (select 1 from known x where (x.from_table, x.from_column, x.to_table, x.to_column) = (pm.from_table, pm.from_column, pm.to_table, pm.to_column))),
every as (select * from united qualify row_number() over (partition by from_table, from_column, to_table, to_column order by confidence desc) = 1)
"""


@query(C + STEM + FK + MATCHES + PATTERNS + EVERY + "select * from every")
def detect_relationships(spark, sf_dir):
    return r.detect_relationships(*_catalogue(spark, sf_dir))


VALUES = " union all ".join(f"""select distinct '{t}' as "table", '{b}' as "column", cast({a} as varchar) as v from {source} where trim(cast({a} as varchar)) <> ''""" for t, (source, cs) in SHAPES.items() for a, b in cs.items())


@query(NAMES + f""", vals as ({VALUES}), sized as (select "table", "column", count(*) as n from vals group by all),
met as (select nm.*, (select count(*) from vals x join vals y using (v) where x."table" = from_table and x."column" = from_column and y."table" = to_table and y."column" = to_column) as overlap_count from nm)
select from_table, from_column, to_table, to_column, cast(least(floor(0.6 * confidence + 40 * overlap_count / greatest(1, least(l.n, r.n)) + 1e-9), 100) as int) as confidence, overlap_count
from met join sized l on l."table" = from_table and l."column" = from_column join sized r on r."table" = to_table and r."column" = to_column""")
def score_relationships(spark, sf_dir):
    columns, tables = _catalogue(spark, sf_dir)
    return r.score_relationships(r.name_match(columns, tables), _frames(spark, sf_dir))


@query(NAMES + "select * from nm where from_table = 'region' or to_table = 'region'")
def relationships_for(spark, sf_dir):
    return r.relationships_for(r.name_match(*_catalogue(spark, sf_dir)), "region")


@query("""select c_mktsegment as "table", count(*) as imports from customer where c_custkey % 10 <> 0 group by 1 having count(*) > 1""")
def duplicate_imports(spark, sf_dir):
    imports = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("table"), (F.col("c_custkey") % 10 == 0).alias("is_master"))
    return r.duplicate_imports(imports)


SETS = C + """, s as (select "table", list_sort(list(distinct lower("column"))) as names from cat group by 1)
"""


@query(SETS + """, p as (select a."table" as source, b."table" as destination, 0.3 * (1 - levenshtein(a."table", b."table") / greatest(length(a."table"), length(b."table"))) + 0.7 * len(list_intersect(a.names, b.names)) / len(list_distinct(a.names || b.names)) as alike
from s a, s b where a."table" = 'stg_customer' and b."table" <> 'stg_customer') select source, destination, cast(floor(100 * alike + 1e-9) as int) as confidence from p where alike > 0.5""")
def wf_import(spark, sf_dir):
    columns, tables = _catalogue(spark, sf_dir)
    return r.import_workflows(tables.withColumn("source_type", F.when(F.col("table") == "stg_customer", "csv").otherwise("mssql")), columns)


STAGED = """, sd as (select distinct "table", tpos from cat), m as (select "table" as source, regexp_replace("table", 'stg_|staging_|temp_|tmp_|_stg|_staging|_temp', '', 'g') as bare from sd
where regexp_matches("table", '^(stg_|staging_|temp_|tmp_|_stg|_staging|_temp)|(stg_|staging_|temp_|tmp_|_stg|_staging|_temp)$')),
j as (select source, sd."table" as destination from m join sd on contains(lower(sd."table"), bare) and source <> sd."table" where bare <> '' qualify row_number() over (partition by source order by lower(sd."table") = bare desc, tpos) = 1),
x as (select source, destination, len(list_intersect(a.names, b.names)) / len(list_distinct(a.names || b.names)) as alike from j join s a on a."table" = source join s b on b."table" = destination),
staged as (select source, destination, cast(floor(100 * alike + 1e-9) as int) as confidence from x where alike > 0.5)
"""


@query(SETS + STAGED + "select * from staged")
def wf_staging(spark, sf_dir):
    columns, tables = _catalogue(spark, sf_dir)
    return r.staging_workflows(tables, columns)


def _workflows_sql(known: str) -> str:
    """``summed`` and ``looked``: aggregations and lookups by the relationships of ``known``."""
    return f""", summed as (select to_table as destination, string_agg(distinct from_table, ',' order by from_table) as sources, 75 as confidence from {known} where regexp_matches(lower(to_table), '_summary|_agg|_total|_aggregate|fact_|sum_') group by 1),
i as (select to_table, count(*) as incoming from {known} group by 1), t as (select "table", max(row_count) as n from cat group by 1),
y as (select "table", coalesce(incoming, 0) as incoming, n, regexp_matches("table", '^(lookup_|ref_|dim_|_ref|_lookup)|(lookup_|ref_|dim_|_ref|_lookup)$') as named from t left join i on to_table = "table"),
looked as (select "table", incoming, case when named then 90 else 70 end as confidence from y where named or (n < 1000 and incoming > 2))
"""


@query(NAMES + _workflows_sql("nm") + "select * from summed")
def wf_aggregation(spark, sf_dir):
    columns, tables = _catalogue(spark, sf_dir)
    return r.aggregation_workflows(tables, r.name_match(columns, tables))


@query(NAMES + _workflows_sql("nm") + "select * from looked")
def wf_lookup(spark, sf_dir):
    columns, tables = _catalogue(spark, sf_dir)
    return r.lookup_tables(tables, r.name_match(columns, tables))


#: Sources of the report, all of them files.
REPORTED = ["customer", "nation", "stg_customer", "sales_summary", "dim_part"]
FILLED = " union all ".join(f"""select '{t}' as "table", '{b}' as "column", cast({a} as varchar) as v from {SHAPES[t][0]}""" for t in REPORTED for a, b in SHAPES[t][1].items())
SETS_OF = SETS.removeprefix(C)


@query(_catalogue_sql(REPORTED, False) + STEM + FK + MATCHES + PATTERNS + EVERY + SETS_OF + STAGED + _workflows_sql("every") + ", " + findings_sql(FILLED) + f"""select 'tables' as metric, count(distinct "table") as count from cat
union all select 'columns', count(*) from cat union all select 'relationships', count(*) from every
union all select 'workflows', (select count(*) from staged) + (select count(*) from summed) + (select count(*) from looked)
union all select 'reconciliation', count(distinct (a.tpos, b.tpos)) from cat a join cat b on lower(a."column") = lower(b."column") and a.tpos < b.tpos
union all select 'multi_value', (select count(*) from {KEPT}) union all select 'groupings', count(*) from cat where unique_count between 1 and 1000""")
def report_summary(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    result = report.run_analysis({n: frames[n] for n in REPORTED}, {n: list(SHAPES[n][1].values())[:1] for n in REPORTED}, head=None)
    return report.report_tables(result)["summary"]


@query("""with a as (select c_custkey as id, c_name as name, c_mktsegment as segment from customer), b as (select id, name, case when id % 4 = 0 then 'none' else segment end as segment from a where id % 5 <> 0),
c as (select id, case when id % 3 = 0 then name || 'x' else name end as name, lower(segment) as segment from a where id % 2 = 0),
p as (select 'a' as source1, 'b' as source2, a.id, a.name as n1, b.name as n2, a.segment as s1, b.segment as s2 from a join b using (id)
union all select 'a', 'c', a.id, a.name, c.name, a.segment, c.segment from a join c using (id) union all select 'b', 'c', b.id, b.name, c.name, b.segment, c.segment from b join c using (id)),
m as (select source1, source2, id::varchar as key_value, 'name' as column_name, n1 as source1_value, n2 as source2_value from p union all select source1, source2, id::varchar, 'segment', s1, s2 from p)
select * from m where lower(trim(source1_value)) <> lower(trim(source2_value)) qualify row_number() over (partition by source1, source2 order by key_value, column_name) <= 50""")
def report_mismatches(spark, sf_dir):
    """The mismatch detail of a report on three sources."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    k = F.col("cust_id")
    b = a.where(k % 5 != 0).withColumn("segment", F.when(k % 4 == 0, "none").otherwise(F.col("segment")))
    c = a.where(k % 2 == 0).select("cust_id", F.when(k % 3 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")).alias("name"), F.lower("segment").alias("segment"))
    sources = {"a": a, "b": b, "c": c}
    columns = catalogue.profile_catalogue(sources, {n: ["cust_id"] for n in sources}, head=None)
    return report.report_tables({"columns": columns, "mismatches": reconcile.mismatches_all(sources)})["mismatches"]


PERCENT = "round_even(100 * {c}, 0)::int || '%' as {c}"


@query("with " + findings_sql(FILLED) + f"""select "table", "column", method, total_count, multi_value_count, {PERCENT.format(c="confidence")} from {KEPT}""")
def report_multi_value(spark, sf_dir):
    """The packed columns of a report, shares as whole percent."""
    frames = {n: df for n, df in _frames(spark, sf_dir).items() if n in REPORTED}
    columns = catalogue.profile_catalogue(frames, {n: list(SHAPES[n][1].values())[:1] for n in frames}, head=None)
    found = report.report_tables({"columns": columns, "multi_value": multivalue.detect_multi_value(frames)})["multi_value"]
    return found.select("table", "column", "method", "total_count", "multi_value_count", "confidence")
