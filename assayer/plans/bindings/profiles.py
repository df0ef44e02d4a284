"""Profiles, measures and proposals on the given tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.functions.dates import quarter_label
from assayer.operators import measures, profile
from assayer.plans import propose
from assayer.plans.bindings.base import TABLES, fields, load, load_all, profile_sql, query, union_sql
from assayer.session import cut


def full_profile(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> DataFrame:
    return profile.profile(load_all(spark, sf_dir, tables))


PROFILE_COLUMNS = """table_name, column_name, normalized_type, ordinal_position, n_rows, n_nulls, null_rate, n_distinct,
  min_value, max_value, is_key, cardinality"""


@query("agg_4", f"with {profile_sql()} select {PROFILE_COLUMNS} from prof")
def column_profile(spark, sf_dir):
    return full_profile(spark, sf_dir)


# every set of two or three columns of every table
SETS = [(t, names) for t in TABLES for n in (2, 3) for names in combinations([c for c, _ in fields(t)], n)]


@query("agg_5", f"""with {profile_sql()},
sets as ({union_sql(
    f"select '{t}' as table_name, ['{"', '".join(cs)}'] as columns, count(*) = count(distinct ({', '.join(cs)})) and count(*) > 0"
    f" and {' and '.join(f'count(*) = count({c})' for c in cs)} as is_key from {t}" for t, cs in SETS)}),
found as (select * from sets where is_key and table_name not in (select table_name from prof where is_key))
select table_name, column_name as key_columns from prof where is_key
union all
select table_name, array_to_string(columns, ',') from found f
where not exists (select 1 from found g where g.table_name = f.table_name and len(g.columns) < len(f.columns) and list_has_all(f.columns, g.columns))""")
def keys(spark, sf_dir):
    tables = load_all(spark, sf_dir)
    single = cut(full_profile(spark, sf_dir).where("is_key").select("table_name", F.col("column_name").alias("key_columns")))
    keyed = {r.table_name for r in single.select("table_name").distinct().collect()}  # table names
    for table in [t for t in TABLES if t not in keyed]:
        sets = profile.composite_keys(tables[table])
        single = single.unionByName(sets.select(F.lit(table).alias("table_name"), F.concat_ws(",", "key_columns").alias("key_columns")))
    return single


@query("agg_6", f"with {profile_sql()} select table_name, column_name, n_distinct, cardinality from prof")
def cardinalities(spark, sf_dir):
    return full_profile(spark, sf_dir).select("table_name", "column_name", "n_distinct", "cardinality")


# money in exact decimals: the product of doubles would leave the last cent to chance
NET = "CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(3,2))) AS DECIMAL(18,2))"


@query("agg_7", """select l_linestatus, count(*) as n, count(distinct l_partkey) as n_parts,
  cast(sum(cast(l_quantity as decimal(18,2))) as double) as quantity,
  round(avg(l_quantity), 6) as mean_quantity, min(l_extendedprice) as low, max(l_extendedprice) as high,
  round(cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / sum(cast(l_quantity as int)), 6) as unit_price
from lineitem group by 1""")
def all_aggregations(spark, sf_dir):
    t = ("lineitem",)
    wanted = [
        measures.Measure("n", "count", "COUNT(*)", t),
        measures.simple_measure("n_parts", "count_distinct", "l_partkey", "lineitem"),
        measures.Measure("quantity", "sum", "CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE)", t),
        measures.Measure("mean_quantity", "avg", "ROUND(AVG(l_quantity), 6)", t),
        measures.simple_measure("low", "min", "l_extendedprice", "lineitem"),
        measures.simple_measure("high", "max", "l_extendedprice", "lineitem"),
        measures.Measure(
            "unit_price", "custom",
            "ROUND(CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / SUM(CAST(l_quantity AS INT)), 6)", t,
        ),
    ]
    return measures.evaluate(load(spark, sf_dir, "lineitem"), wanted, ["l_linestatus"])


def returned_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: revenue of returned lines by market segment and month of order."""
    star = (
        load(spark, sf_dir, "lineitem")
        .join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    revenue = measures.Measure(
        "revenue", "sum", f"CAST(SUM({NET}) AS DOUBLE)", ("lineitem",), "l_returnflag = 'R'", "currency_usd", "approved"
    )
    lines = measures.Measure("n_lines", "count", "COUNT(*)", ("lineitem",), "l_returnflag = 'R'", "integer", "approved")
    by_month = measures.evaluate(star, [revenue, lines], ["c_mktsegment"], ("o_orderdate", "month"), approved_only=True)
    return by_month.withColumn("month", F.col("month").cast("string"))


@query("agg_8", """select c_mktsegment, cast(cast(date_trunc('month', o_orderdate) as date) as varchar) as month,
  cast(sum(cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(3,2))) as decimal(18,2))) as double) as revenue, count(*) as n_lines
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
where l_returnflag = 'R' group by 1, 2""")
def revenue_by_segment(spark, sf_dir):
    return returned_revenue(spark, sf_dir)


def net_by_order(spark, sf_dir):
    """Net value per order; lines shrink to orders before they meet them."""
    net = F.expr(NET)
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(net).alias("net"))


@query("agg_9", """with net as (select l_orderkey, sum(cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(3,2))) as decimal(18,2))) as net from lineitem group by 1),
v as (select o_custkey, year(o_orderdate) || '-Q' || quarter(o_orderdate) as quarter,
  cast(sum(cast(o_totalprice as decimal(18,2))) as double) as declared, cast(sum(net) as double) as billed
  from orders left join net on l_orderkey = o_orderkey group by 1, 2)
select o_custkey, quarter, declared, billed, round((billed - declared) / nullif(declared, 0), 6) as difference,
  abs(billed - declared) > 1000 as disagrees from v""")
def variants(spark, sf_dir):
    joined = load(spark, sf_dir, "orders").join(net_by_order(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    wanted = [
        measures.Measure("declared", "sum", "CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)", ("orders",)),
        measures.Measure("billed", "sum", "CAST(SUM(net) AS DOUBLE)", ("lineitem",)),
    ]
    both = measures.evaluate(joined, wanted, ["o_custkey", quarter_label(F.col("o_orderdate")).alias("quarter")])
    compared = measures.compare_variants(both, "declared", ["billed"], 1000.0)
    return compared.select(
        "o_custkey", "quarter", "declared", "billed", F.round("billed_vs_declared", 6).alias("difference"),
        F.col("billed_disagrees").alias("disagrees"),
    )


PERIODS = ["week", "month", "quarter", "year"]


@query("agg_13", union_sql([
    f"select '{t}' as table_name, '{c}' as column_name, case when bool_and({x} = date_trunc('year', {x})) then 'year' "
    f"when bool_and({x} = date_trunc('quarter', {x})) then 'quarter' when bool_and({x} = date_trunc('month', {x})) then 'month' "
    f"when bool_and({x} = date_trunc('week', {x})) then 'week' else 'day' end as grain from {t}"
    for t, c, x in [("orders", "o_orderdate", "o_orderdate"), ("lineitem", "l_shipdate", "l_shipdate"), ("events", "ts", "ts")]
    + [("orders", f"by_{g}", f"date_trunc('{g}', o_orderdate)") for g in PERIODS]
]))
def grains(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderdate", *[F.date_trunc(g, "o_orderdate").alias(f"by_{g}") for g in PERIODS])
    return profile.time_grains({"orders": orders, "lineitem": load(spark, sf_dir, "lineitem"), "events": load(spark, sf_dir, "events")})


# every column but nested ones, whose text form no two engines share
PLAIN = {t: [c for c, k in fields(t) if k != "json"] for t in TABLES}


@query("srt_3", f"""with cells as ({union_sql(
    f"select '{t}' as table_name, '{c}' as column_name, cast({c} as varchar) as value, count(*) as n from {t} where {c} is not null group by 3"
    for t, names in PLAIN.items() for c in names)}),
ranked as (select *, row_number() over (partition by table_name, column_name order by n desc, value) as rank from cells)
select table_name, column_name, value, n, rank from ranked where rank <= 5""")
def top_values(spark, sf_dir):
    ranked = profile.top_values(load_all(spark, sf_dir), PLAIN, 5)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


# ---- proposals ----

@query("prp_2", f"""with {profile_sql()}, m as (
  select table_name, column_name, a.aggregation, upper(a.aggregation) || '(' || column_name || ')' as sql_expression
  from prof, (values ('sum'), ('avg'), ('min'), ('max')) a(aggregation) where normalized_type = 'numeric' and not is_key
  union all select table_name, column_name, 'count_distinct', 'COUNT(DISTINCT ' || column_name || ')' from prof
  where is_key and normalized_type in ('integer', 'string')
  union all select distinct table_name, null, 'count', 'COUNT(*)' from prof)
select table_name, column_name, aggregation, sql_expression, table_name || '_' || coalesce(column_name, 'rows') || '_' || aggregation as name from m""")
def measure_proposals(spark, sf_dir):
    return propose.measures(cut(full_profile(spark, sf_dir)))


DIMENSION_FILTER = """not is_key and n_distinct > 0 and normalized_type in ('string', 'boolean', 'integer') and cardinality in ('low', 'medium')"""


@query("prp_3", f"""with {profile_sql()},
cells as ({union_sql(
    f"select '{t}' as table_name, '{c}' as column_name, cast({c} as varchar) as value, count(*) as n from {t} where {c} is not null group by 3"
    for t in TABLES for c, k in fields(t) if k in ("string", "integer"))}),
ranked as (select *, row_number() over (partition by table_name, column_name order by n desc, value) as rank from cells),
tops as (select table_name, column_name, string_agg(value, '|' order by rank) as sample_values from ranked where rank <= 5 group by 1, 2)
select table_name, column_name, cardinality as cardinality_hint, n_distinct, sample_values
from prof join tops using (table_name, column_name) where {DIMENSION_FILTER}""")
def dimension_proposals(spark, sf_dir):
    tables = load_all(spark, sf_dir)
    return dimension_rows(tables, profile.profile(tables))


def dimension_rows(tables: dict[str, DataFrame], profiled: DataFrame) -> DataFrame:
    proposed = cut(propose.dimensions(profiled))
    candidates: dict[str, list[str]] = {}
    for row in proposed.select("table_name", "column_name").collect():  # column names only
        candidates.setdefault(row.table_name, []).append(row.column_name)
    # samples of these few-valued columns only; five values per column
    tops = profile.top_values(tables, candidates, 5).groupBy("table_name", "column_name").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("top")
    )
    return proposed.join(tops, ["table_name", "column_name"]).select(
        "table_name", "column_name", "cardinality_hint", "n_distinct",
        F.array_join(F.transform("top", lambda t: t["value"]), "|").alias("sample_values"),
    )


TIME_COLUMNS = [(t, c) for t in TABLES for c, k in fields(t) if k in ("date", "timestamp")]


@query("prp_4", union_sql(
    f"select '{t}' as table_name, '{c}' as column_name, case when bool_and({c} = date_trunc('year', {c})) then 'year' "
    f"when bool_and({c} = date_trunc('quarter', {c})) then 'quarter' when bool_and({c} = date_trunc('month', {c})) then 'month' "
    f"when bool_and({c} = date_trunc('week', {c})) then 'week' else 'day' end as granularity_hint from {t}"
    for t, c in TIME_COLUMNS
))
def time_proposals(spark, sf_dir):
    tables = load_all(spark, sf_dir, sorted({t for t, _ in TIME_COLUMNS}))
    return time_rows(tables, profile.profile(tables))


def time_rows(tables: dict[str, DataFrame], profiled: DataFrame) -> DataFrame:
    return propose.time_dimensions(profiled, profile.time_grains({t: tables[t] for t in sorted({t for t, _ in TIME_COLUMNS})}))
