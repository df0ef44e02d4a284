"""Quality checks and reconciliations on the given tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from assayer.functions.dates import quarter_label
from assayer.operators import profile, quality, reconcile
from assayer.operators.relations import orphans
from assayer.plans import propose
from assayer.plans.bindings.base import ORACLE, QUERIES, TABLES, fields, load, load_all, query, union_sql
from assayer.plans.bindings.profiles import NET, net_by_order
from assayer.session import cut

LABELLED_SQL = "(select d.lang, d.source, l.quality, l.toxic from documents d left join labels l on l.doc_id = d.doc_id)"


def labelled_documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(
        load(spark, sf_dir, "labels"), "doc_id", "left"
    ).drop("doc_id")


def null_flags_sql(threshold: float) -> str:
    return union_sql(
        f"select case when (count(*) - count({c})) / count(*) > 0.5 then 'error' else 'warning' end as severity, 'High NULL rate' as title, "
        f"'labelled' as table_name, '{c}' as column_name, (count(*) - count({c})) || ' of ' || count(*) || ' rows are NULL' as evidence, "
        f"round((count(*) - count({c})) / count(*), 6) as measured, cast({threshold} as double) as threshold "
        f"from {LABELLED_SQL} having (count(*) - count({c})) / count(*) > {threshold}"
        for c in ("lang", "source", "quality", "toxic")
    )


def null_flags(spark, sf_dir):
    return quality.null_rates(profile.profile({"labelled": labelled_documents(spark, sf_dir)}), 0.1)


@query("dq_1", null_flags_sql(0.1))
def null_rates(spark, sf_dir):
    return null_flags(spark, sf_dir)


SPELLING_CASE = "case p_type when 'ECONOMY' then upper(p_name) when 'SMALL' then p_name || ' Inc.' when 'PROMO' then replace(p_name, ' ', '-') else p_name end"
PLAIN_CANON = "replace(regexp_replace(trim(regexp_replace(upper(raw), '[^A-Z0-9]+', ' ', 'g')), ' INC$', ''), ' ', '')"


@query("dq_2", f"""with n as (select 'part.p_name' as place, p_name as raw from part union all select 'sales.customer', {SPELLING_CASE} from part),
c as (select place, raw, {PLAIN_CANON} as canonical from n)
select canonical, count(distinct raw) as n_spellings, count(*) as n_rows, min(raw) as first_spelling, max(raw) as last_spelling,
  count(distinct place) as n_columns from c group by 1 having count(distinct raw) > 1""")
def spellings(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    sales = part.select(F.expr(SPELLING_CASE).alias("customer"))
    return quality.spelling_variants([("part", "p_name", part), ("sales", "customer", sales)])


STATUS_CASE = """case o_orderpriority when '1-URGENT' then o_orderstatus when '2-HIGH' then lower(o_orderstatus)
  when '3-MEDIUM' then case o_orderstatus when 'O' then 'Open' when 'F' then 'Filled' else 'Pending' end
  else upper(case o_orderstatus when 'O' then 'Open' when 'F' then 'Filled' else 'Pending' end) end"""


@query("dq_3", f"""with v as (select {STATUS_CASE} as s from orders), f as (select s, upper(s) as folded from v),
b as (select distinct left(folded, n) as short, folded as long from f, unnest([1, 2, 3]) as u(n) where length(folded) > 3),
a as (select short, min(long) as long from b group by 1 having count(*) = 1),
c as (select coalesce(long, folded) as code, s from f left join a on short = folded)
select code, count(distinct s) as n_spellings, count(*) as n_rows, min(s) as first_spelling, max(s) as last_spelling
from c group by 1 having count(distinct s) > 1""")
def codes(spark, sf_dir):
    # upper-cased constants are written out: to fold them, the driver would load all collation tables of Spark
    folded = "case o_orderstatus when 'O' then 'OPEN' when 'F' then 'FILLED' else 'PENDING' end"
    spelled = STATUS_CASE[:STATUS_CASE.index("upper(")] + folded + " end"
    return quality.code_variants(load(spark, sf_dir, "orders").select(F.expr(spelled).alias("s")), "s")


@query("dq_4", """select 'documents' as table_name, count(*) as n_rows, count(*) filter (where n_chars <> length(text)) as n_violations,
  round(count(*) filter (where n_chars <> length(text)) / count(*), 6) as violation_rate from documents
union all select 'part', count(*), count(*) filter (where abs(p_retailprice - (900 + (p_partkey % 1000) / 10)) > 0.001),
  round(count(*) filter (where abs(p_retailprice - (900 + (p_partkey % 1000) / 10)) > 0.001) / count(*), 6) from part
union all select 'lineitem', count(*), count(*) filter (where l_shipdate < o_orderdate),
  round(count(*) filter (where l_shipdate < o_orderdate) / count(*), 6) from lineitem join orders on l_orderkey = o_orderkey""")
def formulas(spark, sf_dir):
    texts = quality.formula_violations(load(spark, sf_dir, "documents"), "n_chars", "length(text)")
    prices = quality.formula_violations(load(spark, sf_dir, "part"), "p_retailprice", "900 + (p_partkey % 1000) / 10", 0.001)
    dated = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(
        load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    shipped = quality.rule_violations(dated, "l_shipdate >= o_orderdate")
    columns = ["n_rows", "n_violations", "violation_rate"]
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(t).alias("table_name"), *columns) for t, df in [("documents", texts), ("part", prices), ("lineitem", shipped)]
    ])


# every numeric column of every table
MEASURED = {t: names for t in TABLES if (names := [c for c, k in fields(t) if k in ("integer", "numeric")])}


def iqr_sql(t: str, c: str) -> str:
    ranked = f"select cast({c} as double) as x, row_number() over (order by {c}) as rn, count(*) over () as n from {t} where {c} is not null"
    return (
        f"select '{t}' as table_name, '{c}' as column_name, q1, q3, q1 - 1.5 * (q3 - q1) as low_fence, q3 + 1.5 * (q3 - q1) as high_fence, "
        f"(select count({c}) from {t}) as n_rows, (select count(*) from {t} where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as n_outliers "
        f"from (select min(x) filter (where rn >= ceil(0.25 * n)) as q1, min(x) filter (where rn >= ceil(0.75 * n)) as q3 from ({ranked}))"
    )


@query("dq_5", union_sql(iqr_sql(t, c) for t, names in MEASURED.items() for c in names))
def outliers(spark, sf_dir):
    return quality.outlier_table(load_all(spark, sf_dir, list(MEASURED)), MEASURED)


@query("dq_5_zscore", union_sql(
    f"select '{t}' as table_name, '{c}' as column_name, count({c}) as n_rows, "
    f"count(*) filter (where abs({c} - m) > 2.0 * s) as n_outliers from {t}, (select avg({c}) as m, stddev({c}) as s from {t})"
    for t, names in MEASURED.items() for c in names
))
def far_from_mean(spark, sf_dir):
    return quality.zscore_table(load_all(spark, sf_dir, list(MEASURED)), MEASURED, 2.0)


CANDIDATES = [(t, "true") for t in TABLES] + [("orders", "o_totalprice < 0"), ("lineitem", "l_quantity = 0"), ("events", "event_type = 'refund'")]


@query("dq_6", union_sql(
    f"select 'info' as severity, 'Empty table' as title, '{t}: {w.replace(chr(39), '')}' as table_name, cast(null as varchar) as column_name, "
    f"'no rows' as evidence, cast(0 as double) as measured, cast(0 as double) as threshold from {t} where {w} having count(*) = 0"
    for t, w in CANDIDATES
))
def dead_tables(spark, sf_dir):
    """Tables and selections of them without a row; one number each, counted in turn."""
    counts = [(f"{t}: {w.replace(chr(39), '')}", load(spark, sf_dir, t).where(w).count()) for t, w in CANDIDATES]
    return quality.empty_tables(spark.createDataFrame(counts, "table_name string, row_count bigint"))


DATED = [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]


@query("dq_7", union_sql(
    f"select '{t}' as table_name, '{c}' as column_name, cast(min(cast({c} as date)) as varchar) as oldest, cast(max(cast({c} as date)) as varchar) as newest, "
    f"count(distinct year({c})) as n_years, date_diff('day', max(cast({c} as date)), date '2024-01-01') as days_behind, "
    f"max(cast({c} as date)) < date '2024-01-01' as before_cutoff, count(distinct year({c})) = 1 as single_year from {t}"
    for t, c in DATED
))
def frozen(spark, sf_dir):
    dated = [quality.staleness(load(spark, sf_dir, t), t, c, "2024-01-01") for t, c in DATED]
    return reduce(DataFrame.unionByName, dated).withColumn("days_behind", F.col("days_behind").cast("bigint"))


@query("dq_8", union_sql(
    f"select '{c}' as column_name, count({c}) as n_rows, count(*) filter (where {c} <> 0) as n_nonzero, "
    f"round(count(*) filter (where {c} <> 0) / count({c}), 6) as nonzero_rate from lineitem"
    for c in ("l_discount", "l_tax")
))
def adjustments(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    return reduce(DataFrame.unionByName, [
        quality.nonzero_rate(lines, c).select(F.lit(c).alias("column_name"), "*") for c in ("l_discount", "l_tax")
    ])


COLLIDING = {
    "sales": ("orders", {"amount": "o_totalprice", "code": "o_orderstatus", "key": "o_orderkey"}),
    "credits": ("lineitem", {"amount": "-l_extendedprice", "code": "l_linenumber", "key": "l_orderkey"}),
}
RANGE_SQL = union_sql(
    f"select '{t}' as table_name, '{c}' as base_name, {'NULL' if e == 'o_orderstatus' else f'min({e})'} as low, {'NULL' if e == 'o_orderstatus' else f'max({e})'} as high, "
    f"'{'string' if e == 'o_orderstatus' else 'integer' if e.endswith(('number', 'key')) else 'numeric'}' as normalized_type from {source}"
    for t, (source, columns) in COLLIDING.items() for c, e in columns.items())


@query("dq_9", f"""with b as ({RANGE_SQL}),
g as (select base_name, count(distinct table_name) as n_tables, count(distinct normalized_type) as n_types, coalesce(max(low) > min(high), false) as disjoint from b group by 1)
select * from g where n_tables > 1 and (n_types > 1 or disjoint)""")
def collisions(spark, sf_dir):
    """Two systems that use the names amount, code and key: of other range, of other type, and alike."""
    tables = {t: load(spark, sf_dir, source).selectExpr(*[f"{e} as {c}" for c, e in columns.items()]) for t, (source, columns) in COLLIDING.items()}
    profiles = profile.profile(tables)
    ranged = profiles.withColumns({
        c: F.when(F.col("normalized_type").isin("integer", "numeric"), F.col(c)) for c in ("min_value", "max_value")
    })
    return quality.name_collisions(ranged, propose.base_name(F.col("column_name")))


@query("set_6", """select o_orderstatus as value, count(*) as n_rows from orders where o_orderstatus not in (select l_linestatus from lineitem) group by 1""")
def domain(spark, sf_dir):
    return quality.outside_domain(load(spark, sf_dir, "orders"), "o_orderstatus", load(spark, sf_dir, "lineitem"), "l_linestatus")


# every text column of every table
TEXTS = {t: names for t in TABLES if (names := [c for c, k in fields(t) if k == "string"])}


@query("jsn_3", union_sql(
    f"select '{t}' as table_name, '{c}' as column_name, count({c}) as n_rows, "
    f"count(*) filter (where json_valid({c}) and left(trim({c}), 1) in ('{{', '[')) as n_json, "
    f"round(count(*) filter (where json_valid({c}) and left(trim({c}), 1) in ('{{', '[')) / count({c}), 6) as json_share from {t}"
    for t, names in TEXTS.items() for c in names
))
def json_text(spark, sf_dir):
    return quality.json_shares(load_all(spark, sf_dir, list(TEXTS)), TEXTS)


# ---- reconciliation: lines are payments of an order, returned lines are credits ----

AMOUNT = "case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end"
PAYMENTS_SQL = f"""pay as (select l_orderkey as reference, cast({AMOUNT} as decimal(18,2)) as a from lineitem),
paid as (select reference, count(*) as n_payments, sum(a) as received, sum(case when a > 0 then a else 0 end) as gross,
  sum(case when a < 0 then a else 0 end) as credited from pay group by 1),
docs as (select o_orderkey as reference, coalesce(received, 1000) + case o_orderstatus when 'F' then 0 when 'O' then 500 else -500 end as total
  from orders left join paid on reference = o_orderkey),
settled as (select d.reference, total, n_payments, received, gross, credited, coalesce(received, 0) - total as difference,
  case when coalesce(n_payments, 0) = 0 then 'unpaid' when coalesce(received, 0) = total then 'exact'
       when coalesce(received, 0) < total then 'partial' else 'over' end as status
  from docs d left join paid p on p.reference = d.reference)"""
SETTLED_SQL = "select reference, cast(total as double) as total, n_payments, cast(received as double) as received, cast(difference as double) as difference"


def settled(spark, sf_dir):
    paid = reconcile.receipts(
        load(spark, sf_dir, "lineitem").withColumn("amount", F.expr(AMOUNT)), F.col("l_orderkey"), "amount"
    )
    shift = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 500).otherwise(-500)
    docs = load(spark, sf_dir, "orders").join(paid.select(F.col("reference").alias("o_orderkey"), "received"), "o_orderkey", "left").select(
        "o_orderkey", (F.coalesce(F.col("received"), F.lit(1000)) + shift).cast("decimal(18,2)").alias("total")
    )
    return reconcile.settlements(docs, "o_orderkey", "total", paid)


def plain(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "reference", F.col("total").cast("double").alias("total"), "n_payments", F.col("received").cast("double").alias("received"),
        F.col("difference").cast("double").alias("difference"), *extra,
    )


@query("rec_1", f"with {PAYMENTS_SQL} {SETTLED_SQL} from settled where n_payments > 1 and status = 'exact' and credited = 0")
def split(spark, sf_dir):
    return plain(reconcile.split_payments(settled(spark, sf_dir)))


@query("rec_2", f"with {PAYMENTS_SQL} {SETTLED_SQL} from settled where gross <> total and credited < 0")
def corrected(spark, sf_dir):
    return plain(reconcile.corrected_payments(settled(spark, sf_dir)))


@query("rec_3", f"""with t as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_tax, {AMOUNT} as amount, case when l_linestatus = 'O' then l_orderkey end as reference from lineitem)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, amount, reference from t where amount < 0 and l_tax <> 0
and (reference is null or reference not in (select o_orderkey from orders where o_orderstatus = 'F'))""")
def refunds(spark, sf_dir):
    """Credits of open lines name their order; only orders in status F are known; untaxed lines are expenses."""
    lines = load(spark, sf_dir, "lineitem").withColumn("amount", F.expr(AMOUNT))
    known = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    lost = reconcile.unattributed(
        lines, F.when(F.col("l_linestatus") == "O", F.col("l_orderkey")), "amount", known, "o_orderkey", F.col("l_tax") == 0
    )
    return lost.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "amount", "reference")


@query("rec_4", f"with {PAYMENTS_SQL} {SETTLED_SQL}, status from settled")
def settlement(spark, sf_dir):
    return plain(settled(spark, sf_dir), "status")


@query("rec_5", """with f as (select cast(cast(date_trunc('month', o_orderdate) as date) as varchar) as month, o_orderstatus as segment,
  sum(cast(o_totalprice as decimal(18,2))) as forecast from orders group by 1, 2),
a as (select cast(cast(date_trunc('month', l_shipdate) as date) as varchar) as month, l_linestatus as segment,
  sum(cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(3,2))) as decimal(18,2))) as actual from lineitem group by 1, 2)
select coalesce(f.month, a.month) as month, coalesce(f.segment, a.segment) as segment, cast(forecast as double) as forecast, cast(actual as double) as actual,
  round((cast(forecast as double) - cast(actual as double)) / nullif(cast(actual as double), 0), 6) as miss
from f full join a on f.month = a.month and f.segment = a.segment""")
def forecast(spark, sf_dir):
    def monthly(table, when, segment, amount, alias):
        month = F.date_trunc("month", when).cast("date").cast("string").alias("month")
        return reconcile.by_period(load(spark, sf_dir, table), [month, F.col(segment).alias("segment")], amount, alias)

    planned = monthly("orders", "o_orderdate", "o_orderstatus", F.col("o_totalprice"), "forecast")
    actual = monthly("lineitem", "l_shipdate", "l_linestatus", F.expr(NET), "actual")
    return reconcile.forecast_vs_actual(planned, actual, ["month", "segment"]).withColumns(
        {c: F.col(c).cast("double") for c in ("forecast", "actual")}
    )


UNIT = "case o_orderstatus when 'F' then 'A' when 'O' then 'N' else 'R' end"


@query("rec_6", f"""with f as (select year(l_shipdate) || '-Q' || quarter(l_shipdate) as quarter, l_returnflag as unit,
  sum(cast(l_extendedprice as decimal(18,2))) as forecast from lineitem group by 1, 2),
p as (select year(o_orderdate) || '-Q' || quarter(o_orderdate) as quarter, {UNIT} as unit, cast(left(o_orderpriority, 1) as int) as version,
  sum(cast(o_totalprice as decimal(18,2))) as planned from orders group by 1, 2, 3),
n as (select *, row_number() over (partition by quarter, unit order by version desc) as rn from p)
select coalesce(f.quarter, n.quarter) as quarter, coalesce(f.unit, n.unit) as unit, cast(forecast as double) as forecast, version, cast(planned as double) as planned,
  round((cast(planned as double) - cast(forecast as double)) / nullif(cast(forecast as double), 0), 6) as drift
from f full join (select * from n where rn = 1) n on n.quarter = f.quarter and n.unit = f.unit""")
def plans(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    plan = reconcile.by_period(
        orders,
        [quarter_label(F.col("o_orderdate")).alias("plan_quarter"), F.expr(UNIT).alias("business_unit"),
         F.left("o_orderpriority", F.lit(1)).cast("int").alias("plan_version")],
        F.col("o_totalprice"), "planned_revenue",
    )
    drift = reconcile.plan_drift(
        load(spark, sf_dir, "lineitem"), "l_shipdate", "l_returnflag", "l_extendedprice", plan,
        "plan_quarter", "business_unit", "planned_revenue", "plan_version",
    )
    return drift.withColumns({c: F.col(c).cast("double") for c in ("forecast", "planned")})


@query("rec_7", """with net as (select l_orderkey, sum(cast(cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(3,2))) as decimal(18,2))) as net from lineitem group by 1),
s as (select o_custkey as entity, year(o_orderdate) || '-Q' || quarter(o_orderdate) as quarter, 'sales' as system, sum(cast(o_totalprice as decimal(18,2))) as amount from orders group by 1, 2
  union all select o_custkey, year(o_orderdate) || '-Q' || quarter(o_orderdate), 'billing', sum(net) from orders join net on l_orderkey = o_orderkey group by 1, 2
  union all select user_id, year(ts) || '-Q' || quarter(ts), 'usage', sum(cast(value as decimal(18,2))) from events group by 1, 2)
select entity, quarter, cast(sum(amount) filter (where system = 'sales') as double) as sales, cast(sum(amount) filter (where system = 'billing') as double) as billing,
  cast(sum(amount) filter (where system = 'usage') as double) as usage, count(distinct system) as n_systems, cast(max(amount) - min(amount) as double) as spread
from s group by 1, 2""")
def systems(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")

    def keyed(entity, when):
        return [F.col(entity).alias("entity"), quarter_label(F.col(when)).alias("quarter")]

    billed = orders.join(net_by_order(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"))
    wide = reconcile.side_by_side({
        "sales": reconcile.by_period(orders, keyed("o_custkey", "o_orderdate"), F.col("o_totalprice"), "amount"),
        "billing": reconcile.by_period(billed, keyed("o_custkey", "o_orderdate"), F.col("net"), "amount"),
        "usage": reconcile.by_period(load(spark, sf_dir, "events"), keyed("user_id", "ts"), F.col("value"), "amount"),
    }, ["entity", "quarter"])
    return wide.withColumns({c: F.col(c).cast("double") for c in ("sales", "billing", "usage", "spread")})


# one row per check: query, condition, severity, title, table, column, evidence, measured value, threshold; all but the first two as SQL
FLAGS = [
    ("dq_2", "true", "warning", "Several spellings of a name", "cast(null as string)", "cast(null as string)",
     "canonical || ': ' || n_spellings || ' spellings on ' || n_rows || ' rows'", "n_spellings", 1.0),
    ("dq_3", "true", "warning", "Several spellings of a code", "'orders'", "'o_orderstatus'",
     "code || ': ' || n_spellings || ' spellings on ' || n_rows || ' rows'", "n_spellings", 1.0),
    ("dq_4", "n_violations > 0", "warning", "Formula violated", "table_name", "cast(null as string)",
     "n_violations || ' of ' || n_rows || ' rows'", "violation_rate", 0.0),
    ("dq_5", "n_outliers > 0", "info", "Outliers", "table_name", "column_name",
     "n_outliers || ' of ' || n_rows || ' values lie beyond the fences'", "n_outliers", 0.0),
    ("dq_7", "before_cutoff or single_year", "info", "Data ends early", "table_name", "column_name",
     "oldest || ' to ' || newest", "days_behind", 0.0),
    ("dq_8", "nonzero_rate < 0.95", "info", "Adjustments are rarely used", "'lineitem'", "column_name",
     "n_nonzero || ' of ' || n_rows || ' values are not zero'", "nonzero_rate", 0.95),
    ("dq_9", "true", "warning", "One name, different meanings", "cast(null as string)", "base_name",
     "n_tables || ' tables, ' || n_types || ' types'", "n_types", 1.0),
    ("set_6", "true", "warning", "Values outside the code table", "'orders'", "'o_orderstatus'",
     "value || ' on ' || n_rows || ' rows'", "n_rows", 0.0),
    ("jsn_3", "json_share > 0", "info", "Text holds JSON", "table_name", "column_name",
     "n_json || ' of ' || n_rows || ' values'", "json_share", 0.0),
    ("rec_3", "true", "warning", "Credit without a document", "'lineitem'", "'l_orderkey'",
     "'line ' || l_linenumber || ' of ' || l_orderkey || ', part ' || l_partkey", "amount", 0.0),
]


def flags_sql() -> str:
    parts = [
        f"select '{severity}' as severity, '{title}' as title, {table.replace('string', 'varchar')} as table_name, {column.replace('string', 'varchar')} as column_name, "
        f"{evidence} as evidence, cast({measured} as double) as measured, cast({threshold} as double) as threshold from ({ORACLE[name]}) where {condition}"
        for name, condition, severity, title, table, column, evidence, measured, threshold in FLAGS
    ]
    parts += [f"select severity, title, table_name, column_name, evidence, measured, threshold from ({sql})" for sql in (null_flags_sql(0.1), ORACLE["dq_6"])]
    return union_sql(parts + ["""select 'warning', 'Orphaned rows', 'documents', 'doc_id', n || ' rows without a label', round(n / total, 6), 0.0
  from (select count(*) filter (where l.doc_id is null) as n, count(*) as total from documents d left join labels l on l.doc_id = d.doc_id) where n > 0"""])


@query("prp_6", flags_sql())
def flags(spark, sf_dir):
    return flag_rows(spark, sf_dir)


def flag_rows(spark, sf_dir, *columns: str) -> DataFrame:
    """The union of all checks in one shape, or some columns of it.

    Each check is written before the next one is planned, so the driver holds the plan and the jobs of one at a time.
    """
    return propose.quality_flags(*[cut(part.select(*columns) if columns else part) for part in flag_parts(spark, sf_dir)])


def flag_parts(spark, sf_dir) -> Iterator[DataFrame]:
    yield null_flags(spark, sf_dir)
    yield dead_tables(spark, sf_dir)
    yield quality.flags_of(
        orphans(load(spark, sf_dir, "documents"), "doc_id", load(spark, sf_dir, "labels"), "doc_id"), "n_orphan_rows > 0",
        "warning", "Orphaned rows", "documents", "doc_id", "n_orphan_rows || ' rows without a label'", "orphan_ratio", 0.0)
    for name, condition, severity, title, table, column, evidence, measured, threshold in FLAGS:
        yield quality.flags_of(QUERIES[name](spark, sf_dir), condition, severity, title, F.expr(table), F.expr(column), evidence, measured, threshold)
