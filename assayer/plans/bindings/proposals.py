"""All six kinds of proposals together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from assayer.plans import propose
from assayer.plans.bindings import checks, profiles, relationships
from assayer.plans.bindings.base import ORACLE, TABLES, fields, load_all, query, union_sql
from assayer.session import cut

# kind, the query that proposes it, and table, column and detail of a proposal as SQL
KINDS = [
    ("entity", "prp_1", "cast(null as string)", "cast(null as string)", "name"),
    ("measure", "prp_2", "table_name", "column_name", "aggregation"),
    ("dimension", "prp_3", "table_name", "column_name", "cardinality_hint"),
    ("time_dimension", "prp_4", "table_name", "column_name", "granularity_hint"),
    ("relationship", "prp_5", "from_table", "from_column", "concat_ws(' ', relationship_type, to_table, to_column)"),
    ("data_quality_flag", "prp_6", "table_name", "column_name", "title"),
]


def proposals(spark, sf_dir, profiled: DataFrame) -> dict[str, DataFrame]:
    """Rows of every kind, from one profile and one search for links.

    Each kind is written before the next one is planned: in one plan the jobs of all kinds would start at once, and the driver
    would hold their plans, code and threads together.
    """
    tables, links = load_all(spark, sf_dir), relationships.Links(spark, sf_dir)
    rows = {
        "prp_1": lambda: relationships.entity_rows(links),
        "prp_2": lambda: propose.measures(profiled),
        "prp_3": lambda: profiles.dimension_rows(tables, profiled),
        "prp_4": lambda: profiles.time_rows(tables, profiled),
        "prp_5": lambda: relationships.relationship_rows(links),
        "prp_6": lambda: checks.flag_rows(spark, sf_dir, "table_name", "column_name", "title"),
    }
    return {
        kind: cut(rows[name]().selectExpr(f"'{kind}' as kind", f"{table} as table_name", f"{column} as column_name", f"{detail} as detail"))
        for kind, name, table, column, detail in KINDS
    }


CATEGORIES_SQL = union_sql(
    f"select '{kind}' as kind, {table.replace('string', 'varchar')} as table_name, {column.replace('string', 'varchar')} as column_name, {detail} as detail "
    f"from ({ORACLE[name]})" for kind, name, table, column, detail in KINDS)


@query("set_5", CATEGORIES_SQL)
def categories(spark, sf_dir):
    return reduce(DataFrame.unionByName, proposals(spark, sf_dir, cut(profiles.full_profile(spark, sf_dir))).values())


@query("agg_11", f"""with p as ({CATEGORIES_SQL}),
k as (select kind, count(*) as n from p group by 1
  union all select kind, 0 from (values {", ".join(f"('{k[0]}')" for k in KINDS)}) v(kind) where kind not in (select kind from p))
select kind, n from k union all select 'total', cast(sum(n) as bigint) from k
union all select 'tables', {len(TABLES)} union all select 'columns', {sum(len(fields(t)) for t in TABLES)}""")
def run_summary(spark, sf_dir):
    profiled = cut(profiles.full_profile(spark, sf_dir))
    found = proposals(spark, sf_dir, profiled)
    extent = profiled.agg(F.count_distinct("table_name").alias("tables"), F.count("*").alias("columns"))
    rows = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("n")) for c in ("tables", "columns")])
    return propose.summary(found).unionByName(extent.select(F.inline(rows)))
