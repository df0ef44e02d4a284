"""Registry, table access, and relations derived from the given tables with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from assayer.functions.types import normalize_native
from assayer.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Columns of the given tables with their normalised types, in order.
SCHEMA = {
    "region": "r_regionkey:integer r_name:string",
    "nation": "n_nationkey:integer n_name:string n_regionkey:integer",
    "customer": "c_custkey:integer c_name:string c_nationkey:integer c_acctbal:numeric c_mktsegment:string",
    "supplier": "s_suppkey:integer s_name:string s_nationkey:integer s_acctbal:numeric",
    "part": "p_partkey:integer p_name:string p_brand:string p_type:string p_size:integer p_retailprice:numeric",
    "orders": "o_orderkey:integer o_custkey:integer o_orderstatus:string o_totalprice:numeric "
              "o_orderdate:timestamp o_orderpriority:string",
    "lineitem": "l_orderkey:integer l_partkey:integer l_suppkey:integer l_linenumber:integer l_quantity:numeric "
                "l_extendedprice:numeric l_discount:numeric l_tax:numeric l_returnflag:string l_linestatus:string "
                "l_shipdate:timestamp",
    "events": "event_id:integer ts:timestamp user_id:integer event_type:string value:numeric props:string",
    "documents": "doc_id:integer text:string lang:string source:string n_chars:integer",
    "embeddings": "vec_id:integer embedding:json label:integer",
    "pages": "page_id:integer url:string html:string",
    "benchmark": "item_id:integer text:string",
    "labels": "doc_id:integer quality:integer toxic:integer",
    "conversations": "conv_id:integer turn:integer role:string text:string",
}
TABLES = list(SCHEMA)


def fields(table: str) -> list[tuple[str, str]]:
    return [tuple(f.split(":")) for f in SCHEMA[table].split()]


_schemas: dict[str, StructType] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table; its schema is looked up in the files once per process."""
    path = f"{sf_dir}/{table}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def load_all(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {t: load(spark, sf_dir, t) for t in names or TABLES}


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def union_sql(parts) -> str:
    return "\nunion all\n".join(parts)


# ---- column profile ----

def described(tables: list[str] | None, extra: dict[str, tuple[str, list[tuple[str, str]]]] | None) -> list[tuple]:
    """(name, what to select from, columns) of the tables and of `extra` ones, which are given by their SQL."""
    return [(t, t, fields(t)) for t in tables or TABLES] + [(t, f"({sql})", columns) for t, (sql, columns) in (extra or {}).items()]


def profile_sql(tables: list[str] | None = None, extra=None) -> str:
    """CTE `prof`: one row per column, as operators.profile gives it."""
    parts = []
    for t, relation, columns in described(tables, extra):
        for i, (c, kind) in enumerate(columns, start=1):
            low, high = ("null", "null") if kind == "json" else (f"cast(min({c}) as varchar)", f"cast(max({c}) as varchar)")
            parts.append(
                f"select '{t}' as table_name, '{c}' as column_name, '{kind}' as normalized_type, {i} as ordinal_position, "
                f"count(*) as n_rows, count(*) - count({c}) as n_nulls, count(distinct {c}) as n_distinct, "
                f"{low} as min_value, {high} as max_value from {relation}"
            )
    return f"""stats as ({union_sql(parts)}),
prof as (
  select table_name, column_name, normalized_type, ordinal_position, n_rows, n_nulls,
         round(n_nulls / n_rows, 6) as null_rate, n_distinct, min_value, max_value,
         (n_rows > 0 and n_nulls = 0 and n_distinct = n_rows) as is_key,
         case when n_rows > 0 and n_nulls = 0 and n_distinct = n_rows then 'very_high'
              when n_distinct <= 10 then 'low' when n_distinct <= 100 then 'medium'
              when n_distinct <= 10000 then 'high' else 'very_high' end as cardinality
  from stats)"""


def value_sql(column: str, kind: str) -> str:
    """A value as text; numbers without zeros at the end of their fraction."""
    text = f"cast({column} as varchar)"
    return rf"regexp_replace(regexp_replace({text}, '^(-?[0-9]+\.[0-9]*?)0+$', '\1'), '\.$', '')" if kind == "numeric" else text


def values_sql(kinds: tuple[str, ...], tables: list[str] | None = None, extra=None) -> str:
    """CTE `vals`: distinct non-null values of every column of the given types, as text."""
    parts = [
        f"select distinct '{t}' as table_name, '{c}' as column_name, '{kind}' as normalized_type, "
        f"{value_sql(c, kind)} as value from {relation} where {c} is not null"
        for t, relation, columns in described(tables, extra)
        for c, kind in columns
        if kind in kinds
    ]
    return f"vals as ({union_sql(parts)})"


# ---- schema snapshots: every order is a snapshot of its customer's warehouse, its lines are columns ----

NATIVE_TYPES = {"F": "character varying", "O": "numeric(12,2)"}


def order_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    native = F.when(F.bool_or(F.col("l_linestatus") == "F"), NATIVE_TYPES["F"]).otherwise(NATIVE_TYPES["O"])
    grouped = lines.groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg(
        native.alias("native_type"),
        (F.max("l_tax") >= 0.05).alias("is_nullable"),
        (F.min("l_discount") == 0).alias("is_key"),
        F.count("*").alias("n_lines"),
        F.min("l_quantity").cast("int").cast("string").alias("low"),
        F.max("l_quantity").cast("int").cast("string").alias("high"),
    )
    return grouped.select(
        F.col("l_orderkey").alias("snapshot_id"), F.lit("wh").alias("database_name"), F.lit("s1").alias("schema_name"),
        F.concat(F.lit("t_"), "l_returnflag").alias("table_name"),
        F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("column_name"),
        normalize_native(F.col("native_type")).alias("normalized_type"), "native_type", "is_nullable",
        F.col("l_linenumber").alias("ordinal_position"), "is_key", "n_lines", "low", "high",
    )


ORDER_COLUMNS_SQL = """sc as (
  select l_orderkey as snapshot_id, 'wh' as database_name, 's1' as schema_name, 't_' || l_returnflag as table_name,
         'c' || l_linenumber as column_name,
         case when min(l_linestatus) = 'F' then 'string' else 'numeric' end as normalized_type,
         case when min(l_linestatus) = 'F' then 'character varying' else 'numeric(12,2)' end as native_type,
         max(l_tax) >= 0.05 as is_nullable, l_linenumber as ordinal_position, min(l_discount) = 0 as is_key,
         count(*) as n_lines, cast(cast(min(l_quantity) as int) as varchar) as low,
         cast(cast(max(l_quantity) as int) as varchar) as high
  from lineitem group by l_orderkey, l_returnflag, l_linenumber)"""


def order_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("src_"), F.col("o_custkey").cast("string")).alias("source_database"),
        F.col("o_orderdate").alias("captured_at"),
        F.when(F.col("o_orderstatus") == "F", "rules-v1").otherwise("rules-v0").alias("prompt_version"),
    )


ORDER_SNAPSHOTS_SQL = """snaps as (
  select o_orderkey as id, 'src_' || o_custkey as source_database, o_orderdate as captured_at,
         case when o_orderstatus = 'F' then 'rules-v1' else 'rules-v0' end as prompt_version,
         row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as age_rank
  from orders)"""


# ---- decision log: every event is a review action on the definition of its user ----

ACTIONS = {"purchase": "approve", "error": "reject", "view": "reopen", "signup": "edit"}


def decision_log(events: DataFrame) -> DataFrame:
    action = F.when(F.lit(False), F.lit(None).cast("string"))
    for event, verb in ACTIONS.items():
        action = action.when(F.col("event_type") == event, verb)
    action = action.when(F.col("event_id") % 40 == 0, "supersede").otherwise("edit")
    return events.select(
        F.col("user_id").cast("string").alias("definition_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
        action.alias("action"), F.col("props").alias("actor"), F.when(F.col("value") > 10, F.col("props")).alias("reason"),
        F.create_map(
            F.lit("name"), F.when(F.col("value") > 20, F.concat(F.lit("n"), F.col("event_id").cast("string"))),
            F.lit("confidence"), F.when(F.col("value") > 30, "high").otherwise("low"),
            F.lit("status"), F.lit("approved"),
        ).alias("fields"),
    )


LOG_SQL = """log as (
  select cast(user_id as varchar) as definition_id, ts as happened, event_id as seq, props as actor,
         case when value > 10 then props end as reason, value,
         case event_type when 'purchase' then 'approve' when 'error' then 'reject' when 'view' then 'reopen'
              when 'signup' then 'edit' else case when event_id % 40 = 0 then 'supersede' else 'edit' end end as action
  from events),
epochs as (
  select *, coalesce(sum(case when action = 'reopen' then 1 else 0 end)
            over (partition by definition_id order by happened, seq rows between unbounded preceding and 1 preceding), 0) as epoch,
         row_number() over (partition by definition_id order by happened, seq) as pos
  from log),
firsts as (
  select *, min(case when action in ('approve', 'reject') then pos end) over (partition by definition_id, epoch) as first_pos
  from epochs),
verbs as (
  select f.*, v.action as first_verb from firsts f
  left join firsts v on v.definition_id = f.definition_id and v.pos = f.first_pos),
ends as (
  select definition_id, min(pos) as end_pos from verbs
  where action = 'supersede' and first_pos < pos and first_verb = 'approve' group by definition_id),
walked as (
  select v.*, case when e.end_pos < v.pos then 'superseded'
                   when v.first_pos < v.pos and v.first_verb = 'approve' then 'approved'
                   when v.first_pos < v.pos and v.first_verb = 'reject' then 'rejected'
                   else 'proposed' end as state_before
  from verbs v left join ends e on e.definition_id = v.definition_id),
outcomes as (
  select *, case when action in ('approve', 'reject', 'edit') and state_before = 'proposed' then 'applied'
                 when action = 'reopen' and state_before <> 'superseded' then 'applied'
                 when action = 'supersede' and state_before = 'approved' then 'applied'
                 when action = 'approve' and state_before = 'approved' then 'noop'
                 when action = 'reject' and state_before = 'rejected' then 'noop'
                 else 'invalid' end as outcome
  from walked)"""


# ---- definitions: every order is one version of its customer's metric ----

def order_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "proposed").otherwise("rejected")
    confidence = (
        F.when(F.col("o_orderpriority") == "5-LOW", "low").when(F.col("o_orderpriority") == "3-MEDIUM", "medium")
        .when(F.col("o_orderpriority") == "2-HIGH", "high").when(F.col("o_orderpriority") == "1-URGENT", "urgent")
    )
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("metric_"), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderpriority").alias("display_name"), F.col("o_orderstatus").alias("description"),
        F.lit(None).cast("string").alias("rationale"), confidence.alias("confidence"), status.alias("status"),
        F.col("o_orderdate").alias("proposed_at"),
        F.when(status == "approved", F.col("o_orderdate")).alias("approved_at"),
        F.when(status == "approved", F.col("o_orderpriority")).alias("approved_by"),
        F.when(status == "rejected", F.col("o_orderkey") - 1).alias("parent_id"),
        F.when(F.col("o_orderkey") >= 1500, F.col("o_orderkey") - 1500).alias("supersedes_id"),
    )


DEFINITIONS_SQL = """defs as (
  select o_orderkey as id, 'metric_' || o_custkey as name, o_orderpriority as display_name, o_orderstatus as description,
         cast(null as varchar) as rationale,
         case o_orderpriority when '5-LOW' then 'low' when '3-MEDIUM' then 'medium' when '2-HIGH' then 'high'
              when '1-URGENT' then 'urgent' end as confidence,
         case o_orderstatus when 'F' then 'approved' when 'O' then 'proposed' else 'rejected' end as status,
         o_orderdate as proposed_at, case when o_orderstatus = 'F' then o_orderdate end as approved_at,
         case when o_orderstatus = 'F' then o_orderpriority end as approved_by,
         case when o_orderstatus not in ('F', 'O') then o_orderkey - 1 end as parent_id,
         case when o_orderkey >= 1500 then o_orderkey - 1500 end as supersedes_id
  from orders)"""


def day(column: str):
    return F.col(column).cast("date").cast("string")
