"""Sources, sinks, samples, scopes and plain projections on the given tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions import dates, jsons, names, text
from assayer.functions.types import normalize_native
from assayer.operators import measures, render, scope, validate
from assayer.plans.bindings.base import (
    DEFINITIONS_SQL, ORDER_COLUMNS_SQL, TABLES, day, fields, load, load_all, order_columns, order_definitions, query,
    union_sql,
)
from assayer.plans.ingest import capture
from assayer.session import scratch_path
from assayer.sources import inventory, sampling, store
from assayer.sources.readers import open_source
from assayer.vocab import CONFIDENCES

# Columns that identify a row of each table, for repeatable samples.
SAMPLE_KEYS = {t: [fields(t)[0][0]] for t in TABLES} | {
    "conversations": ["conv_id", "turn"],
    "lineitem": [c for c, _ in fields("lineitem")],
}


def sample_key(table: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in SAMPLE_KEYS[table]])


def sample_key_sql(table: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"cast({c} as varchar)" for c in SAMPLE_KEYS[table]) + "))"


def own_tables(spark, sf_dir):
    """The source of the given tables only, whatever else lies in the folder."""
    source = open_source(spark, "parquet", sf_dir, database="warehouse")
    return replace(source, tables=[t for t in source.tables if t.name in TABLES])


COUNTS = [f"select '{t}' as table_name, count(*) as row_count, {len(fields(t))} as n_columns from {t}" for t in TABLES]


@query("src_1", f"select 'public' as schema_name, table_name, row_count from ({union_sql(COUNTS)})")
def table_list(spark, sf_dir):
    source = own_tables(spark, sf_dir)
    counted = inventory.row_counts(spark, source).select("schema_name", "table_name", "row_count")
    return inventory.table_inventory(spark, source).select("schema_name", "table_name").join(
        counted, ["schema_name", "table_name"]
    ).orderBy("schema_name", "table_name")


@query("src_2", union_sql(
    f"select '{t}' as table_name, '{c}' as column_name, '{kind}' as normalized_type, {i} as ordinal_position, "
    f"count({c}) as n_values from {t}"
    for t in TABLES for i, (c, kind) in enumerate(fields(t), start=1)
))
def column_list(spark, sf_dir):
    source = own_tables(spark, sf_dir)
    filled = []
    for t in source.tables:
        df = source.read(t)
        counted = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(df.columns)])
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_values")) for i, c in enumerate(df.columns)])
        filled.append(counted.select(F.lit(t.name).alias("table_name"), F.inline(rows)))
    return inventory.column_inventory(spark, source).select(
        "table_name", "column_name", "normalized_type", "ordinal_position"
    ).join(reduce(DataFrame.unionByName, filled), ["table_name", "column_name"]).orderBy("table_name", "ordinal_position")


@query("src_3", """
select o_orderkey as table_name, string_agg('c' || l_linenumber, ',' order by l_linenumber) as primary_key_columns
from orders join (select distinct l_orderkey, l_linenumber from lineitem) on o_orderkey = l_orderkey
where o_orderstatus = 'F' group by o_orderkey""")
def key_columns(spark, sf_dir):
    """Orders in status F as key constraints, their line numbers as key positions."""
    constraints = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("table_name"))
    usage = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("table_name"), F.col("l_linenumber").alias("key_position"),
        F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("column_name"),
    ).distinct()
    ordered = inventory.ordered_names(usage.join(constraints, "table_name"), ["table_name"], "key_position", "column_name", "k")
    return ordered.select("table_name", F.array_join("k", ",").alias("primary_key_columns"))


@query("src_4", f"select table_name, row_count, false as is_estimate from ({union_sql(COUNTS)})")
def counts(spark, sf_dir):
    return inventory.row_counts(spark, own_tables(spark, sf_dir)).select("table_name", "row_count", "is_estimate")


ORDER_SAMPLE_SQL = """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(cast(o_orderdate as date) as varchar) as o_orderdate,
  o_orderpriority from orders order by md5(cast(o_orderkey as varchar)) limit 10"""


def order_sample(spark, sf_dir):
    return sampling.sample_rows(load(spark, sf_dir, "orders"), 10, F.col("o_orderkey"))


@query("src_5", ORDER_SAMPLE_SQL)
def sample(spark, sf_dir):
    return order_sample(spark, sf_dir).withColumn("o_orderdate", day("o_orderdate"))


@query("src_6", union_sql(f"select '{t}' as table_name, count(*) > 10 as truncated from {t}" for t in TABLES))
def truncated(spark, sf_dir):
    return reduce(DataFrame.unionByName, [
        sampling.has_more_rows(df, 10).select(F.lit(t).alias("table_name"), "truncated")
        for t, df in load_all(spark, sf_dir).items()
    ])


@query("src_7", f"""select table_name, cast(null as varchar) as comment, 0 as n_commented_columns, row_count
from ({union_sql(COUNTS)})""")
def comments(spark, sf_dir):
    """Comments as the files carry them (these carry none) next to the counted rows."""
    source = own_tables(spark, sf_dir)
    commented = inventory.column_inventory(spark, source).groupBy("table_name").agg(
        F.count("comment").cast("int").alias("n_commented_columns")
    )
    listed = inventory.table_inventory(spark, source).select("table_name", "comment")
    counted = inventory.row_counts(spark, source).select("table_name", "row_count")
    return listed.join(commented, "table_name").join(counted, "table_name")


@query("src_8", f"""select 'parquet' as kind, 'warehouse.public.' || table_name as qualified, row_count, n_columns
from ({union_sql(COUNTS)})""")
def readers(spark, sf_dir):
    source = own_tables(spark, sf_dir)
    counted = inventory.row_counts(spark, source)
    widths = inventory.column_inventory(spark, source).groupBy("table_name").agg(F.max("ordinal_position").alias("n_columns"))
    return counted.join(widths, "table_name").select(
        F.lit(source.kind).alias("kind"),
        names.qualified(F.col("database_name"), F.col("schema_name"), F.col("table_name")).alias("qualified"),
        "row_count", "n_columns",
    )


def _sampled_column_sql(t: str, i: int, c: str, kind: str) -> str:
    return (
        f"select '{t}' as table_name, '{c}' as column_name, '{kind}' as normalized_type, {i} as ordinal_position, "
        f"count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as distinct_sample_count, "
        f"(select count(*) from {t}) as row_count "
        f"from (select * from {t} order by {sample_key_sql(t)} limit 10)"
    )


@query("src_9", union_sql(_sampled_column_sql(t, i, c, k) for t in TABLES for i, (c, k) in enumerate(fields(t), start=1)))
def snapshot(spark, sf_dir):
    captured = capture(spark, own_tables(spark, sf_dir), sample_key=lambda ref: sample_key(ref.name))
    return captured.columns.join(captured.tables.select("table_name", "row_count_estimate"), "table_name").select(
        "table_name", "column_name", "normalized_type", "ordinal_position", "distinct_sample_count",
        F.col("row_count_estimate").alias("row_count"),
    )


# ---- sinks: parts as the columns of 25 snapshots ----

def part_columns(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy("p_brand", "p_size", "p_name").agg(
        F.min("p_partkey").alias("first_part"), F.max("p_retailprice").alias("top_price"), F.min("p_type").alias("kind"),
        F.count("*").alias("n_parts"),
    ).select(
        F.col("p_brand").alias("snapshot_id"), F.lit("wh").alias("database_name"), F.lit("public").alias("schema_name"),
        F.concat(F.lit("t_"), F.col("p_size").cast("string")).alias("table_name"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("column_name"),
        F.lit("string").alias("normalized_type"), F.lit("text").alias("native_type"),
        (F.col("top_price") > 950).alias("is_nullable"), F.col("first_part").cast("int").alias("ordinal_position"),
        F.lit(None).cast("string").alias("comment"),
        F.when(F.col("n_parts") > 1, F.array("kind", F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")).alias("sample_values"),
        F.col("n_parts").alias("distinct_sample_count"), "top_price",
    )


PART_COLUMNS_SQL = """pc as (
  select p_brand as snapshot_id, 't_' || p_size as table_name, replace(p_name, ' ', '_') as column_name,
         max(p_retailprice) > 950 as is_nullable, min(p_partkey) as ordinal_position, min(p_type) as kind, count(*) as n_parts,
         max(p_retailprice) as top_price
  from part group by p_brand, p_size, p_name)"""


def stored_part_snapshots(spark, sf_dir) -> str:
    """Writes the part snapshots to a fresh folder of the shared store."""
    root = scratch_path(spark, "store")
    columns = part_columns(spark, sf_dir)
    tables = columns.groupBy("snapshot_id", "database_name", "schema_name", "table_name").agg(
        F.sum("distinct_sample_count").alias("row_count_estimate"),
        F.sort_array(F.collect_set(F.when(F.col("top_price") > 990, F.col("column_name")))).alias("primary_key_columns"),
    ).withColumn("comment", F.lit(None).cast("string"))
    snapshots = columns.groupBy(F.col("snapshot_id").alias("id")).agg(F.min("ordinal_position").alias("first")).select(
        "id", F.lit("2026-01-01").cast("timestamp_ntz").alias("captured_at"), F.lit("wh").alias("source_database"),
        F.lit(None).cast("string").alias("scope_id"), F.lit("rules-v1").alias("rule_version"), F.lit(None).cast("string").alias("fingerprint"),
    )
    store.persist_snapshots(root, snapshots, tables, columns)
    return root


@query("snk_1", f"""with {PART_COLUMNS_SQL},
pt as (select snapshot_id, table_name, count(*) as n_columns, sum(n_parts) as n_rows, count(*) filter (where top_price > 990) as n_keys
       from pc group by 1, 2)
select snapshot_id, count(*) as n_tables, cast(sum(n_columns) as bigint) as n_columns, cast(sum(n_rows) as bigint) as n_rows,
       count(*) filter (where n_keys = 0) as n_without_key,
       (select count(*) from pc where pc.snapshot_id = pt.snapshot_id and n_parts > 1) as n_sampled_columns
from pt group by snapshot_id""")
def persist(spark, sf_dir):
    root = stored_part_snapshots(spark, sf_dir)
    tables = store.read_table(spark, root, "snapshot_tables", store.TABLES_DDL)
    columns = store.read_table(spark, root, "snapshot_columns", store.COLUMNS_DDL)
    per_table = tables.groupBy("snapshot_id").agg(
        F.count("*").alias("n_tables"), F.sum("row_count_estimate").alias("n_rows"),
        F.count(F.when(F.col("primary_key_columns").isNull(), 1)).alias("n_without_key"),
    )
    per_column = columns.groupBy("snapshot_id").agg(
        F.count("*").alias("n_columns"), F.count("sample_values_json").alias("n_sampled_columns")
    )
    return per_table.join(per_column, "snapshot_id")


@query("snk_2", f"""with {PART_COLUMNS_SQL}
select snapshot_id, table_name, string_agg(column_name, ',' order by ordinal_position) as columns,
       string_agg(case when n_parts > 1 then kind || '/NULL' else '' end, ',' order by ordinal_position) as samples,
       coalesce(string_agg(column_name, ',' order by column_name) filter (where top_price > 990), '') as keys,
       0 as sample_rows_returned, false as sample_truncated
from pc group by 1, 2""")
def load_back(spark, sf_dir):
    loaded = store.load_snapshots(spark, stored_part_snapshots(spark, sf_dir))
    return loaded.select(
        "snapshot_id", "table_name",
        F.array_join(F.transform("columns", lambda c: c["column_name"]), ",").alias("columns"),
        F.array_join(F.transform("columns", lambda c: F.array_join(c["sample_values"], "/", "NULL")), ",").alias("samples"),
        F.array_join("primary_key_columns", ",").alias("keys"), "sample_rows_returned", "sample_truncated",
    )


@query("snk_3", f"""with {PART_COLUMNS_SQL}
select 'part_' || p_partkey as name, 'proposed' as status, 'user:7' as proposed_by, 1 as n_links
from part where p_type <> 'PROMO'""")
def persist_proposals(spark, sf_dir):
    """Every part proposes an entity on its own column; PROMO parts name one that does not exist and are held back."""
    root = stored_part_snapshots(spark, sf_dir)
    part = load(spark, sf_dir, "part")
    column = F.when(F.col("p_type") == "PROMO", "no_such_column").otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    reference = F.struct(F.concat(F.lit("wh.public.t_"), F.col("p_size").cast("string")).alias("table"), column.alias("column"))
    nothing = F.lit(None).cast("string")
    proposals = part.select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("display_name"),
        F.col("p_type").alias("description"), F.lit("").alias("rationale"), F.array("p_brand").alias("evidence"),
        F.lit("high").alias("confidence"), F.lit("2026-01-02").cast("timestamp_ntz").alias("proposed_at"),
        F.lit("rules-v1").alias("prompt_version"), nothing.alias("model"), F.col("p_brand").alias("source_snapshot_id"),
        nothing.alias("scope_id"), F.array(reference).alias("source_columns"),
    )
    store.persist_definitions(root, proposals, store.stored_column_ids(spark, root), "user:7", mode="quarantine")
    links = store.read_table(spark, root, "definition_columns", store.LINKS_DDL).groupBy("entity_id").agg(
        F.count("*").cast("int").alias("n_links")
    )
    stored = store.read_table(spark, root, "definitions", store.DEFINITIONS_DDL)
    return stored.join(links, stored["id"] == links["entity_id"]).select("name", "status", "proposed_by", "n_links")


@query("snk_4", f"""with {PART_COLUMNS_SQL}
select snapshot_id, table_name, column_name, ordinal_position, is_nullable from pc""")
def dump(spark, sf_dir):
    path = scratch_path(spark, "json")
    chosen = part_columns(spark, sf_dir).select(
        "snapshot_id", "table_name", "column_name", F.col("ordinal_position").cast("bigint").alias("ordinal_position"), "is_nullable"
    )
    store.dump_json(chosen, path)
    return spark.read.schema(chosen.schema).json(path)


# ---- projections and filters ----

NATIVE_CASE = """case l_linenumber when 1 then 'INTEGER' when 2 then 'varchar(' || cast(cast(l_quantity as int) as varchar(20)) || ')'
  when 3 then 'Timestamp with time zone' when 4 then ' numeric(12,2) ' when 5 then 'jsonb' when 6 then 'BOOL' else 'geometry' end"""


@query("prj_1", f"""with t as (select lower(trim({NATIVE_CASE})) as native_type from lineitem)
select native_type, case
  when regexp_matches(native_type, 'smallint|integer|bigint|int2|int4|int8|int64|serial') then 'integer'
  when regexp_matches(native_type, 'numeric|decimal|real|double|float|money') then 'numeric'
  when regexp_matches(native_type, 'boolean|bool') then 'boolean'
  when regexp_matches(native_type, 'timestamp|datetime') then 'timestamp'
  when regexp_matches(native_type, 'date') then 'date'
  when regexp_matches(native_type, 'json|jsonb') then 'json'
  when regexp_matches(native_type, 'character|varchar|char|text|string|uuid') then 'string'
  else 'unknown' end as normalized_type, count(*) as n
from t group by 1, 2""")
def native_types(spark, sf_dir):
    typed = load(spark, sf_dir, "lineitem").select(F.expr(NATIVE_CASE).alias("t"))
    return typed.groupBy(F.lower(F.trim("t")).alias("native_type"), normalize_native(F.col("t")).alias("normalized_type")).agg(
        F.count("*").alias("n")
    )


@query("prj_2", """select p_partkey, 'wh.' || p_brand || '.' || p_name as three_parts, p_brand || '.' || p_name as two_parts from part""")
def qualified(spark, sf_dir):
    return load(spark, sf_dir, "part").select(
        "p_partkey", names.qualified(F.lit("wh"), F.col("p_brand"), F.col("p_name")).alias("three_parts"),
        names.qualified(F.col("p_brand"), F.col("p_name")).alias("two_parts"),
    )


REFERENCE_CASE = """case event_type when 'view' then 'db.s.t_' || user_id when 'click' then 's.t_' || user_id
  when 'error' then 't_' || user_id when 'signup' then 'a.b.c.t_' || user_id else 'DB.S.T' end"""


@query("prj_3", f"""with r as (select event_id, string_split({REFERENCE_CASE}, '.') as p from events)
select event_id, case when len(p) in (2, 3) then p[len(p) - 1] end as schema_name,
       case when len(p) in (2, 3) then p[len(p)] end as table_name from r""")
def split_names(spark, sf_dir):
    schema, table = names.split_qualified(F.expr(REFERENCE_CASE))
    return load(spark, sf_dir, "events").select("event_id", schema.alias("schema_name"), table.alias("table_name"))


def part_tables(spark, sf_dir):
    """Parts as a table inventory: brands are schemas."""
    return load(spark, sf_dir, "part").select(
        F.col("p_brand").alias("schema_name"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("table_name"), "p_size",
    )


@query("flt_1", """select p_brand as schema_name, 't' || p_partkey as table_name from part
where p_brand in ('Brand#1', 'Brand#2', 'Brand#13') and p_size <= 40""")
def scoped(spark, sf_dir):
    tables = part_tables(spark, sf_dir)
    hidden = tables.where("p_size > 40").select(F.concat_ws(".", "schema_name", "table_name"))
    return scope.apply_scope(tables.drop("p_size"), ["Brand#1", "Brand#2", "Brand#13"], hidden)


@query("flt_2", f"""with {DEFINITIONS_SQL}
select id, name, cast(cast(proposed_at as date) as varchar) as proposed_at from defs where status = 'proposed'""")
def by_status(spark, sf_dir):
    chosen = order_definitions(spark, sf_dir).where("status = 'proposed'")
    return scope.newest_first(chosen, "proposed_at").select("id", "name", day("proposed_at").alias("proposed_at"))


@query("flt_3", f"""with {DEFINITIONS_SQL}
select display_name, count(*) as n_queryable, count(distinct name) as n_names from defs where status = 'approved' group by 1""")
def approved_only(spark, sf_dir):
    gate = measures.Measure("n_queryable", "count", "COUNT(*)", ("definitions",), "status = 'approved'", status="approved")
    unique = measures.Measure("n_names", "count_distinct", "COUNT(DISTINCT name)", ("definitions",), "status = 'approved'", status="approved")
    return measures.evaluate(order_definitions(spark, sf_dir), [gate, unique], ["display_name"], approved_only=True)


NEWEST_SQL = f"""{DEFINITIONS_SQL},
newest as (select name, display_name, row_number() over (partition by name order by approved_at desc, id) as rn,
    count(*) over (partition by name) as versions from defs where status = 'approved'),
asked as (select name, display_name from newest where rn = 1 order by versions desc, name limit 3)"""


@query("flt_3_registry", f"""with {NEWEST_SQL}
select o_orderstatus, name, count(*) filter (where o_orderpriority = display_name) as n_orders from orders, asked group by 1, 2""")
def approved_by_name(spark, sf_dir):
    """The three names with the most approved versions, each evaluated as its newest one has it: orders of that version's priority."""
    orders = load(spark, sf_dir, "orders")
    versions = order_definitions(spark, sf_dir).select(
        "id", "name", "status", "approved_at", F.lit("count").alias("aggregation"), F.lit("COUNT(*)").alias("sql_expression"),
        F.array(F.lit("orders")).alias("source_tables"), F.format_string("o_orderpriority = '%s'", "display_name").alias("filter_expression"),
        F.lit(None).cast("string").alias("format_hint"))
    asked = versions.where("status = 'approved'").groupBy("name").count().orderBy(F.desc("count"), "name").limit(3)
    names = [r["name"] for r in asked.collect()]
    found = measures.MeasureRegistry(versions).evaluate(orders, names, ["o_orderstatus"])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(F.col(n), F.lit(0)).alias("n_orders")) for n in names])
    return found.select("o_orderstatus", F.inline(rows))


@query("flt_4", """select count(*) as n_lines, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount
from lineitem where l_returnflag = 'R' and l_quantity > 25""")
def measure_filter(spark, sf_dir):
    condition = "l_returnflag = 'R' and l_quantity > 25"
    wanted = [
        measures.Measure("n_lines", "count", "COUNT(*)", ("lineitem",), condition),
        measures.Measure("amount", "custom", "CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)", ("lineitem",), condition),
    ]
    return measures.evaluate(load(spark, sf_dir, "lineitem"), wanted)


@query("flt_5", f"""with {DEFINITIONS_SQL}
select id, confidence, case confidence when 'high' then 3 else 2 end as confidence_rank from defs where confidence in ('high', 'medium')""")
def by_confidence(spark, sf_dir):
    ranked = order_definitions(spark, sf_dir).select("id", "confidence", validate.confidence_rank(F.col("confidence")).alias("confidence_rank"))
    return ranked.where("confidence_rank >= 2").orderBy(F.desc("confidence_rank"), "id")


@query("flt_6", f"""with {DEFINITIONS_SQL}
select id, confidence, case when confidence is null or confidence not in ('low', 'medium', 'high') then 'bad confidence' else 'bad status' end as reason
from defs where confidence is null or confidence not in ('low', 'medium', 'high') or status not in ('proposed', 'approved')""")
def closed_vocabularies(spark, sf_dir):
    reason = validate.enum_reason({"confidence": CONFIDENCES, "status": ["proposed", "approved"]})
    _, rejected = validate.quarantine(order_definitions(spark, sf_dir), reason)
    return rejected.select("id", "confidence", "reason")


@query("flt_7", """with r as (select event_id, case event_type when 'view' then 'unlinked_dimension' else 'exact_match' end as kind,
  value > 10 as has_table, value > 5 as has_column from events)
select event_id, kind as relationship_type, case when has_table <> has_column then 'one target side only' else 'target needed' end as reason
from r where has_table <> has_column or (not has_table and kind <> 'unlinked_dimension')""")
def coherent_targets(spark, sf_dir):
    relations = load(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "view", "unlinked_dimension").otherwise("exact_match").alias("relationship_type"),
        F.when(F.col("value") > 10, F.col("props")).alias("to_table"), F.when(F.col("value") > 5, F.col("props")).alias("to_column"),
    )
    _, rejected = validate.quarantine(relations, validate.target_reason())
    return rejected.select("event_id", "relationship_type", "reason")


@query("flt_8", """with d as (select doc_id, len(string_split(text, chr(10))) as n from documents)
select doc_id, case when n < 2 then 'lines needs at least 2' else 'lines takes at most 10' end as reason from d where n < 2 or n > 10""")
def list_sizes(spark, sf_dir):
    listed = load(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    _, rejected = validate.quarantine(listed, validate.size_reason("lines", 2, 10))
    return rejected.select("doc_id", "reason")


@query("flt_9", """with n as (select case when p_size > 25 then replace(p_name, ' ', '_') || '_' || p_size else p_name end as name from part)
select name, regexp_full_match(name, '[a-z][a-z0-9_]*') as is_machine_name, regexp_matches(name, '[0-9]$') as ends_in_number, count(*) as n
from n group by 1, 2, 3""")
def machine_names(spark, sf_dir):
    name = F.when(
        F.col("p_size") > 25, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"))
    ).otherwise(F.col("p_name"))
    return load(spark, sf_dir, "part").select(name.alias("name")).groupBy(
        "name", names.is_machine_name(F.col("name")).alias("is_machine_name"), names.ends_in_number(F.col("name")).alias("ends_in_number")
    ).agg(F.count("*").alias("n"))


@query("set_3", """select l_suppkey as scope_id, p_brand as schema_name from lineitem join part on p_partkey = l_partkey
where p_brand not in (select p_brand from part group by p_brand having max(p_size) = 50) group by 1, 2""")
def unknown_schemas(spark, sf_dir):
    """Suppliers as scopes over the brands they ship; brands offering the largest size are the available schemas."""
    part = load(spark, sf_dir, "part")
    scopes = load(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("scope_id"), F.col("p_brand").alias("schema_name")
    )
    available = part.groupBy(F.col("p_brand").alias("schema_name")).agg(F.max("p_size").alias("top")).where("top = 50")
    return scope.unknown_schemas(scopes, available)


@query("agg_10", """select p_brand as schema_name, 't' || p_partkey as table_name, count(*) over (partition by p_brand) as n_tables from part""")
def tables_per_schema(spark, sf_dir):
    return inventory.tables_by_schema(part_tables(spark, sf_dir))


@query("agg_12", """select c_custkey, coalesce(s.n, 0) as n_snapshots, coalesce(d.n, 0) as n_definitions,
  coalesce(s.n, 0) + coalesce(d.n, 0) = 0 as deletable
from customer left join (select o_custkey, count(*) as n from orders group by 1) s on s.o_custkey = c_custkey
left join (select user_id, count(*) as n from events group by 1) d on d.user_id = c_custkey""")
def references(spark, sf_dir):
    return scope.reference_counts(
        load(spark, sf_dir, "customer"), "c_custkey",
        {"n_snapshots": (load(spark, sf_dir, "orders"), "o_custkey"), "n_definitions": (load(spark, sf_dir, "events"), "user_id")},
    )


# ---- samples ----

@query("agg_1", f"""with s as (select *, row_number() over (order by md5(cast(o_orderkey as varchar))) as pos from ({ORDER_SAMPLE_SQL}))
{union_sql(f"select '{c}' as column_name, string_agg(cast({c} as varchar), '|' order by pos) as sample_values from s" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))}""")
def sample_values(spark, sf_dir):
    # the ten sampled rows come out of one task in order
    placed = order_sample(spark, sf_dir).drop("o_orderdate").withColumn("pos", F.monotonically_increasing_id())
    kept = sampling.column_samples(sampling.long_form(placed, keep=["pos"]), "pos")
    return kept.select("column_name", F.array_join("sample_values", "|", "NULL").alias("sample_values"))


LABELLED = "(select d.doc_id, d.lang, l.quality, l.toxic from documents d left join labels l on l.doc_id = d.doc_id)"


@query("agg_2", union_sql(
    f"select '{c}' as column_name, count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as n_distinct from {LABELLED}"
    for c in ("doc_id", "lang", "quality", "toxic")
))
def distinct_with_null(spark, sf_dir):
    joined = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    return sampling.long_form(joined).groupBy("column_name").agg(sampling.distinct_with_null(F.col("value")).alias("n_distinct"))


@query("agg_3", """select 'embedding' as column_name, count(distinct embedding) as n_distinct from embeddings
union all select 'props' as column_name, count(distinct props) as n_distinct from events""")
def distinct_nested(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings").select("embedding")
    parsed = load(spark, sf_dir, "events").select(F.from_json("props", "map<string,string>").alias("props"))
    cells = sampling.long_form(vectors).unionByName(sampling.long_form(parsed))
    return cells.groupBy("column_name").agg(sampling.distinct_with_null(F.col("value")).alias("n_distinct"))


@query("srt_1", f"""with {DEFINITIONS_SQL}
select id, name, status, cast(cast(proposed_at as date) as varchar) as proposed_at from defs""")
def newest_first(spark, sf_dir):
    return scope.newest_first(order_definitions(spark, sf_dir), "proposed_at").select("id", "name", "status", day("proposed_at").alias("proposed_at"))


@query("srt_2", f"""with {ORDER_COLUMNS_SQL}
select snapshot_id, table_name, string_agg(column_name, ',' order by ordinal_position) as columns from sc group by 1, 2""")
def by_ordinal(spark, sf_dir):
    ordered = inventory.ordered_names(order_columns(spark, sf_dir), ["snapshot_id", "table_name"], "ordinal_position", "column_name", "names")
    return ordered.select("snapshot_id", "table_name", F.array_join("names", ",").alias("columns"))


@query("srt_4", """select event_id, user_id, event_type, value, props from events order by md5(cast(event_id as varchar)) limit 25""")
def event_sample(spark, sf_dir):
    return sampling.sample_rows(load(spark, sf_dir, "events"), 25, F.col("event_id")).drop("ts")


# ---- scalar functions ----

@query("str_1", """select doc_id, regexp_matches(lower(trim(text)), 'the|tion|eau') as hit, length(lower(trim(text))) as n from documents""")
def lower_trim(spark, sf_dir):
    plain = F.lower(F.trim("text"))
    return load(spark, sf_dir, "documents").select("doc_id", plain.rlike("the|tion|eau").alias("hit"), F.length(plain).cast("bigint").alias("n"))


@query("str_2", """with n as (select p_name as name from part union all select c_name from customer union all select n_name from nation)
select left(upper(regexp_replace(name, '[^A-Za-z]', '', 'g')), 4) as block, count(*) as n from n group by 1""")
def block_keys(spark, sf_dir):
    all_names = (
        load(spark, sf_dir, "part").select("p_name").union(load(spark, sf_dir, "customer").select("c_name"))
        .union(load(spark, sf_dir, "nation").select("n_name")).toDF("name")
    )
    return all_names.groupBy(names.block_key(F.col("name")).alias("block")).agg(F.count("*").alias("n"))


COMPANY_CASE = """case p_type when 'ECONOMY' then p_name || ' Corp.' when 'SMALL' then upper(p_name) || ', Inc.'
  when 'PROMO' then p_name || ' Industries LLC' when 'LARGE' then 'the ' || p_name || ' Group PLC' else p_name end"""
CANONICAL_SQL = r"""replace(regexp_replace(trim(regexp_replace(upper({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')),
  '( (CORPORATION|CORP|INCORPORATED|INC|LIMITED|LTD|LLC|PLC|COMPANY|CO|GROUP|GRP|HOLDINGS|HLDGS|HOLD|INDUSTRIES|IND|ENTERPRISES|ENT|SYSTEMS|SYS|IMPORTS|IMPORT))+$', ''), ' ', '')"""


@query("str_3", f"""with n as (select {COMPANY_CASE} as name from part)
select {CANONICAL_SQL.format("name")} as canonical, count(*) as n, count(distinct name) as n_spellings from n group by 1""")
def canonical_names(spark, sf_dir):
    named = load(spark, sf_dir, "part").select(F.expr(COMPANY_CASE).alias("name"))
    return named.groupBy(names.canonical_name(F.col("name")).alias("canonical")).agg(
        F.count("*").alias("n"), F.count_distinct("name").alias("n_spellings")
    )


PAYMENT_CASE = """case event_type when 'purchase' then 'WIRE PAYMENT ACME REF INV-2024-' || lpad(cast(user_id as varchar(20)), 4, '0')
  when 'click' then 'ACH PAYMENT ACME PARTIAL REF INV-2023-' || lpad(cast(user_id as varchar(20)), 4, '0') || ' THANKS'
  when 'error' then 'REFUND - UNMATCHED' else 'PAYROLL EXPENSE' end"""


@query("str_4", f"""select event_id, nullif(regexp_extract({PAYMENT_CASE}, 'REF (INV-[0-9]{{4}}-[0-9]{{4}})', 1), '') as reference from events""")
def payment_references(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", text.extract_reference(F.expr(PAYMENT_CASE)).alias("reference"))


def quote_sql(c: str) -> str:
    body = (
        f"replace(replace(replace(replace({c}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    )
    return (
        f"case when contains({c}, '''') and not contains({c}, '\"') then '\"' || {body} || '\"' "
        f"else '''' || replace({body}, '''', '\\''') || '''' end"
    )


def display_sql(c: str) -> str:
    return f"coalesce(case when length({quote_sql(c)}) > 60 then substring({quote_sql(c)}, 1, 57) || '…''' else {quote_sql(c)} end, 'NULL')"


@query("str_5", f"""with l as (select d.doc_id, case when q.doc_id is not null then d.text end as v from documents d left join labels q on q.doc_id = d.doc_id)
select doc_id, {display_sql("v")} as shown from l""")
def display(spark, sf_dir):
    labelled = load(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    joined = load(spark, sf_dir, "documents").select("doc_id", "text").join(labelled, "doc_id", "left")
    return joined.select("doc_id", text.display_value(F.when(F.col("labelled"), F.col("text"))).alias("shown"))


@query("str_6", f"""with l as (select doc_id, string_split(text, chr(10)) as lines from documents)
select doc_id, array_to_string(list_transform(lines[1:5], lambda v: {display_sql("v")}), ', ')
  || case when len(lines) > 5 then ', …(+' || (len(lines) - 5) || ' more)' else '' end as shown from l""")
def display_lines(spark, sf_dir):
    shown = F.transform(F.split("text", "\n"), lambda v: text.display_value(v))
    return load(spark, sf_dir, "documents").select("doc_id", text.display_samples(shown).alias("shown"))


@query("str_7", """select o_orderkey, '~' || format('{:,}', o_orderkey * 1000 + o_custkey) as shown from orders""")
def separators(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", text.approximate_count(F.col("o_orderkey") * 1000 + F.col("o_custkey")).alias("shown")
    )


WRAPPED_CASE = """case event_type when 'view' then '```json' || chr(10) || props || chr(10) || '```'
  when 'click' then 'Here you are: ' || props || ' - done.' when 'error' then '  no json } here { ' when 'signup' then '  ' || props || chr(10) else props end"""


@query("str_8", f"""with w as (select event_id, regexp_replace({WRAPPED_CASE}, '^\\s+|\\s+$', '', 'g') as t from events)
select event_id, coalesce(nullif(regexp_extract(t, '(?s)\\{{.*\\}}', 0), ''), t) as body from w""")
def bodies(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", text.json_body(F.expr(WRAPPED_CASE)).alias("body"))


LINE_SQL = """'| ' || ordinal_position || ' | `' || column_name || '` | `' || normalized_type || '` | `' || native_type || '` | '
  || case when is_nullable then 'yes' else 'no' end || ' | ' || n_lines || ' | '
  || case when normalized_type = 'string' then '''' || low || ''', ''' || high || '''' else low || ', ' || high end || ' |'"""


@query("str_9", f"""with {ORDER_COLUMNS_SQL}
select snapshot_id, table_name, '## Table: `wh.s1.' || table_name || '`' || chr(10) || chr(10) || '- **Primary key:** '
  || coalesce(string_agg('`' || column_name || '`', ', ' order by ordinal_position) filter (where is_key), '_(none detected)_') || chr(10)
  || '- **Row count (estimate):** ~' || format('{{:,}}', cast(sum(n_lines) * 1000 as bigint)) || chr(10)
  || '- **Sample:** 2 rows (truncated, more rows exist)' || chr(10) || chr(10) || '### Columns' || chr(10) || chr(10)
  || '{render.COLUMN_HEADER[0]}' || chr(10) || '{render.COLUMN_HEADER[1]}' || chr(10)
  || string_agg({LINE_SQL}, chr(10) order by ordinal_position) as markdown
from sc group by snapshot_id, table_name""")
def markdown(spark, sf_dir):
    entry = F.struct(
        "ordinal_position", "column_name", "normalized_type", "native_type", "is_nullable",
        F.array("low", "high").alias("sample_values"), F.col("n_lines").alias("distinct_sample_count"), "is_key",
    )
    # at most one entry per column of the table
    tables = order_columns(spark, sf_dir).groupBy("snapshot_id", "database_name", "schema_name", "table_name").agg(
        F.sort_array(F.collect_list(entry)).alias("columns"), (F.sum("n_lines") * 1000).alias("row_count_estimate")
    )
    keys = F.transform(F.filter("columns", lambda c: c["is_key"]), lambda c: c["column_name"])
    full = tables.withColumn("primary_key_columns", keys).withColumn("comment", F.lit(None).cast("string")).withColumn(
        "sample_rows_returned", F.lit(2)
    ).withColumn("sample_truncated", F.lit(True))
    return render.describe_tables(full).select("snapshot_id", "table_name", "markdown")


@query("jsn_1", """select doc_id, cast(to_json([lang, nullif(source, 'src0'), cast(n_chars as varchar)]) as varchar) as encoded from documents""")
def encode(spark, sf_dir):
    values = F.array("lang", F.nullif("source", F.lit("src0")), F.col("n_chars").cast("string"))
    return load(spark, sf_dir, "documents").select("doc_id", jsons.encode_samples(values).alias("encoded"))


@query("dat_1", union_sql(
    f"select '{g}' as grain, cast(cast(date_trunc('{g}', o_orderdate) as date) as varchar) as period, count(*) as n from orders group by 2"
    for g in ("day", "week", "month", "quarter", "year")
))
def truncations(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    periods = F.array(*[
        F.struct(F.lit(g).alias("grain"), dates.truncate(g, F.col("o_orderdate")).cast("string").alias("period"))
        for g in ("day", "week", "month", "quarter", "year")
    ])
    return orders.select(F.inline(periods)).groupBy("grain", "period").agg(F.count("*").alias("n"))


@query("dat_2", """select year(l_shipdate) || '-Q' || quarter(l_shipdate) as quarter, count(*) as n from lineitem group by 1""")
def quarters(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(dates.quarter_label(F.col("l_shipdate")).alias("quarter")).agg(F.count("*").alias("n"))


@query("mth_1", """with a as (select o_orderkey, o_totalprice as amount, case when o_orderpriority = '1-URGENT' then null else o_custkey % 13 end as months from orders)
select o_orderkey, round(amount * 12 / nullif(months, 0), 6) as annual,
       round((amount * 12 / nullif(months, 0) - amount) / nullif(amount, 0), 6) as difference from a""")
def annualised(spark, sf_dir):
    months = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey") % 13)
    annual = dates.annualise(F.col("o_totalprice"), months)
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(annual, 6).alias("annual"),
        F.round(dates.relative_difference(annual, F.col("o_totalprice")), 6).alias("difference"),
    )
