"""Snapshot histories, references, definitions and review decisions derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.operators import lifecycle, snapshot, validate
from assayer.plans.bindings.base import (
    DEFINITIONS_SQL, LOG_SQL, ORDER_COLUMNS_SQL, ORDER_SNAPSHOTS_SQL, day, decision_log, load, order_columns,
    order_definitions, order_snapshots, query,
)
from assayer.session import cut, scratch_path
from assayer.streaming import decisions

SIGNATURES_SQL = """sig as (
  select snapshot_id, '["column","wh","s1","' || table_name || '","' || column_name || '","' || normalized_type || '","' || native_type || '","'
    || case when is_nullable then 'true' else 'false' end || '","' || ordinal_position || '"]' as signature from sc
  union select snapshot_id, '["key","wh","s1","' || table_name || '","' || column_name || '"]' from sc where is_key)"""


def word(start: int) -> str:
    return f"cast(sum(cast('0x' || substr(md5(signature), {start}, 8) as bigint)) as varchar)"


PRINTS_SQL = f"""prints as (select snapshot_id, concat_ws('-', cast(count(*) as varchar), {", ".join(word(s) for s in (1, 9, 17, 25))}) as fingerprint
  from sig group by 1)"""


def signed(spark, sf_dir) -> DataFrame:
    return snapshot.signatures(order_columns(spark, sf_dir), None, ["snapshot_id"])


def prints(spark, sf_dir) -> DataFrame:
    return snapshot.fingerprints(signed(spark, sf_dir), ["snapshot_id"])


@query("agg_14", f"with {ORDER_COLUMNS_SQL}, {SIGNATURES_SQL}, {PRINTS_SQL} select * from prints")
def fingerprints(spark, sf_dir):
    return prints(spark, sf_dir)


@query("win_1", f"""with {ORDER_SNAPSHOTS_SQL}, v as (select event_id, max(event_type) as prompt_version from events group by 1)
select s.id, source_database, cast(cast(captured_at as date) as varchar) as captured_at, v.prompt_version
from snaps s left join v on v.event_id = s.id where age_rank = 1""")
def latest(spark, sf_dir):
    definitions = load(spark, sf_dir, "events").select(
        F.col("event_id").alias("source_snapshot_id"), F.col("event_type").alias("prompt_version")
    )
    newest = snapshot.latest_with_version(order_snapshots(spark, sf_dir).drop("prompt_version"), definitions)
    return newest.select("id", "source_database", day("captured_at").alias("captured_at"), "prompt_version")


# newest and previous snapshot of every source, with the columns of each
PAIR_SQL = f"""{ORDER_COLUMNS_SQL}, {ORDER_SNAPSHOTS_SQL}, {SIGNATURES_SQL},
cols as (select source_database, age_rank, sc.* from sc join snaps on snaps.id = snapshot_id where age_rank <= 2)"""


def newest_two(spark, sf_dir) -> DataFrame:
    return snapshot.latest(order_snapshots(spark, sf_dir), n=2).withColumnRenamed("id", "snapshot_id")


def of_age(df: DataFrame, pairs: DataFrame, rank: int) -> DataFrame:
    chosen = pairs.where(F.col("age_rank") == rank).select("snapshot_id", "source_database")
    return df.join(chosen, "snapshot_id").drop("snapshot_id")


def two_sided(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the newest and the previous snapshot of every source, in one pass."""
    side = F.when(F.col("age_rank") == 1, "new").otherwise("old").alias("side")
    return df.join(pairs.select("snapshot_id", "source_database", side), "snapshot_id").drop("snapshot_id")


@query("set_1", f"""with {PAIR_SQL},
s as (select distinct source_database, age_rank, signature from sig join snaps on snaps.id = snapshot_id where age_rank <= 2),
d as (select source_database, signature from s group by 1, 2 having count(*) = 1),
n as (select source_database, count(*) as n from d group by 1)
select distinct snaps.source_database, coalesce(n, 0) as n_differences, coalesce(n, 0) = 0 as equivalent
from snaps left join n on n.source_database = snaps.source_database""")
def equivalence(spark, sf_dir):
    pairs = newest_two(spark, sf_dir)
    difference = snapshot.structural_difference(two_sided(signed(spark, sf_dir), pairs), ["source_database"])
    counted = difference.groupBy("source_database").agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return pairs.where("age_rank = 1").select("source_database").join(counted, "source_database", "left").select(
        "source_database", n.alias("n_differences"), (n == 0).alias("equivalent")
    )


@query("set_2", f"""with {PAIR_SQL},
o as (select * from cols where age_rank = 2), n as (select * from cols where age_rank = 1),
j as (select coalesce(o.source_database, n.source_database) as source_database, coalesce(o.table_name, n.table_name) as table_name,
  coalesce(o.column_name, n.column_name) as column_name, o.column_name is not null as in_old, n.column_name is not null as in_new,
  o.native_type <> n.native_type as retyped, o.is_nullable <> n.is_nullable as renulled, o.ordinal_position <> n.ordinal_position as moved, o.is_key <> n.is_key as rekeyed
  from o full join n on o.source_database = n.source_database and o.table_name = n.table_name and o.column_name = n.column_name),
t as (select source_database, table_name, bool_or(in_old) as t_old, bool_or(in_new) as t_new from j group by 1, 2),
b as (select j.* from j join t on t.source_database = j.source_database and t.table_name = j.table_name where t_old and t_new)
select source_database, table_name, column_name, 'column_added' as change from b where not in_old
union all select source_database, table_name, column_name, 'column_removed' from b where not in_new
union all select source_database, table_name, column_name, 'type_changed' from b where retyped
union all select source_database, table_name, column_name, 'nullability_changed' from b where renulled
union all select source_database, table_name, column_name, 'moved' from b where moved
union all select source_database, table_name, column_name, 'key_changed' from b where rekeyed
union all select source_database, table_name, null, 'table_added' from t where t_new and not t_old
union all select source_database, table_name, null, 'table_removed' from t where t_old and not t_new""")
def differences(spark, sf_dir):
    both = two_sided(order_columns(spark, sf_dir), newest_two(spark, sf_dir))
    changed = snapshot.schema_diff(both, ["source_database"])
    return changed.select("source_database", "table_name", "column_name", "change")


@query("set_4", f"""with {ORDER_COLUMNS_SQL}, {ORDER_SNAPSHOTS_SQL}, {SIGNATURES_SQL}, {PRINTS_SQL},
c as (select source_database, fingerprint from snaps join prints on snapshot_id = id where age_rank = 1),
p as (select source_database, id, fingerprint, prompt_version from snaps join prints on snapshot_id = id where age_rank = 2)
select c.source_database, coalesce(c.fingerprint = p.fingerprint and prompt_version = 'rules-v1', false) as skip,
  case when c.fingerprint = p.fingerprint and prompt_version = 'rules-v1' then p.id end as last_snapshot_id
from c left join p on p.source_database = c.source_database""")
def skips(spark, sf_dir):
    # two rows per source, used twice
    marked = cut(newest_two(spark, sf_dir).join(prints(spark, sf_dir), "snapshot_id")).withColumnRenamed("snapshot_id", "id")
    decided = snapshot.skip_decisions(
        marked.where("age_rank = 1").select("source_database", "fingerprint"), marked.where("age_rank = 2"), "rules-v1"
    )
    return decided.drop("last_captured_at")


@query("jn_11", f"""with {PAIR_SQL},
l as (select source_database, source_database || '/' || table_name as definition_id, table_name, column_name, normalized_type from cols where age_rank = 2),
n as (select source_database, table_name, column_name, normalized_type as new_type from cols where age_rank = 1)
select l.source_database, definition_id, case max(case when new_type is null then 2 when new_type <> normalized_type then 1 else 0 end)
  when 2 then 'broken' when 1 then 'needs_review' else 'compatible' end as compatibility
from l left join n on n.source_database = l.source_database and n.table_name = l.table_name and n.column_name = l.column_name group by 1, 2""")
def compatibility(spark, sf_dir):
    """One definition per table of the previous snapshot, on all its columns."""
    pairs, columns = newest_two(spark, sf_dir), order_columns(spark, sf_dir)
    links = of_age(columns, pairs, 2).withColumn("definition_id", F.concat_ws("/", "source_database", "table_name"))
    return snapshot.compatibility(links, of_age(columns, pairs, 1), ["source_database"])


# ---- references: every line refers to the column after its own ----

REFERENCES_SQL = """refs as (select distinct l_orderkey as snapshot_id,
  case when l_linestatus = 'O' then 'wh.s1.t_' || l_returnflag else 's1.t_' || l_returnflag end as "table", 'c' || (l_linenumber + 1) as column_name from lineitem),
hits as (select r.*, md5(concat_ws('|', cast(r.snapshot_id as varchar), 's1', sc.table_name, sc.column_name)) as column_id, sc.column_name is not null as found
  from refs r left join sc on sc.snapshot_id = r.snapshot_id and 't_' || right(r."table", 1) = sc.table_name and r.column_name = sc.column_name)"""


def reference_inputs(spark, sf_dir):
    table = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("wh.s1.t_"), "l_returnflag")).otherwise(F.concat(F.lit("s1.t_"), "l_returnflag"))
    references = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("snapshot_id"), table.alias("table"),
        F.concat(F.lit("c"), (F.col("l_linenumber") + 1).cast("string")).alias("column_name"),
    ).distinct()
    place = ["snapshot_id", "schema_name", "table_name", "column_name"]
    known = order_columns(spark, sf_dir).withColumn("column_id", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in place])))
    return references, known


@query("jn_1", f'with {ORDER_COLUMNS_SQL}, {REFERENCES_SQL} select snapshot_id, "table", column_name, column_id from hits where found')
def resolved(spark, sf_dir):
    found, _ = validate.ground(*reference_inputs(spark, sf_dir), mode="quarantine")
    return found.select("snapshot_id", "table", "column_name", "column_id")


@query("jn_2", f'with {ORDER_COLUMNS_SQL}, {REFERENCES_SQL} select snapshot_id, "table", column_name from hits where not found')
def unresolved(spark, sf_dir):
    _, lost = validate.ground(*reference_inputs(spark, sf_dir), mode="quarantine")
    return lost.select("snapshot_id", "table", "column_name")


@query("jn_3", """select p_partkey as definition_id, p_name as name, r_name || '.' || n_name as "table", s_name as "column"
from part join (select distinct l_partkey, l_suppkey from lineitem) on l_partkey = p_partkey join supplier on s_suppkey = l_suppkey
join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey""")
def lineage(spark, sf_dir):
    """Parts as definitions, suppliers as columns, nations as tables, regions as schemas."""
    definitions = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    links = load(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").alias("snapshot_column_id")
    ).distinct().withColumn("id", F.concat_ws("/", F.col("entity_id").cast("string"), F.col("snapshot_column_id").cast("string")))
    columns = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("table_id"), F.col("s_name").alias("column_name")
    )
    tables = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("id"), F.col("r_name").alias("schema_name"), F.col("n_name").alias("table_name")
    )
    return validate.hydrate(definitions, links, columns, tables).select(F.col("entity_id").alias("definition_id"), "name", "table", "column")


# ---- definitions ----

@query("jn_12", f"""with {DEFINITIONS_SQL}, r as (select *, row_number() over (partition by name order by approved_at desc, id) as rn from defs where status = 'approved')
select name, id, cast(cast(approved_at as date) as varchar) as approved_at, approved_by from r where rn = 1""")
def resolve_names(spark, sf_dir):
    current = lifecycle.resolve_names(order_definitions(spark, sf_dir))
    return current.select("name", "id", day("approved_at").alias("approved_at"), "approved_by")


@query("jn_12_chain", f"""with recursive {DEFINITIONS_SQL}, c as (select id, id as root_id, 0 as depth from defs where supersedes_id is null
  union all select d.id, c.root_id, c.depth + 1 from defs d join c on d.supersedes_id = c.id)
select id, root_id, depth from c""")
def version_chains(spark, sf_dir):
    return lifecycle.supersession_roots(order_definitions(spark, sf_dir))


EDITED = ["name", "display_name", "description", "rationale", "confidence"]


@query("jn_13", f"""with {DEFINITIONS_SQL}, j as (select c.id, c.parent_id, {", ".join(f"p.{f} as o_{f}, c.{f} as c_{f}" for f in EDITED)} from defs c join defs p on p.id = c.parent_id)
{" union all ".join(f"select id, parent_id, '{f}' as field, o_{f} as original, c_{f} as current from j where o_{f} is distinct from c_{f}" for f in EDITED)}""")
def edited(spark, sf_dir):
    return lifecycle.edited_fields(order_definitions(spark, sf_dir))


# ---- review decisions ----

FOLD_SQL = f"""with {LOG_SQL},
last as (select definition_id,
  max_by(action, pos) filter (where outcome = 'applied' and action <> 'edit') as final, count(*) as n_actions,
  max_by(actor, pos) filter (where outcome = 'applied' and action = 'approve') as approved_by,
  max(happened) filter (where outcome = 'applied' and action = 'approve') as approved_at,
  max_by(actor, pos) filter (where outcome = 'applied' and action = 'reject') as rejected_by,
  max(happened) filter (where outcome = 'applied' and action = 'reject') as rejected_at,
  max(pos) filter (where outcome = 'applied' and action = 'reject') as reject_pos,
  max(happened) filter (where outcome = 'applied' and action = 'reopen') as reopened_at from outcomes group by 1)
select l.definition_id, case final when 'approve' then 'approved' when 'reject' then 'rejected' when 'supersede' then 'superseded' else 'proposed' end as status,
  approved_by, cast(approved_at as varchar) as approved_at, rejected_by, cast(rejected_at as varchar) as rejected_at, o.reason as rejected_reason,
  cast(reopened_at as varchar) as reopened_at, n_actions
from last l left join outcomes o on o.definition_id = l.definition_id and o.pos = reject_pos"""


def walked(spark, sf_dir):
    return lifecycle.states(decision_log(load(spark, sf_dir, "events")))


def with_text_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ("approved_at", "rejected_at", "reopened_at")})


@query("win_2", FOLD_SQL)
def current_states(spark, sf_dir):
    return with_text_times(lifecycle.fold(walked(spark, sf_dir)))


@query("win_3", f"""with {LOG_SQL} select definition_id, seq, action, state_before, outcome,
  case when outcome = 'invalid' then 'cannot ' || action || ' a definition that is ' || state_before end as reason from outcomes""")
def outcomes(spark, sf_dir):
    return walked(spark, sf_dir).select(
        "definition_id", "seq", "action", "state_before", "outcome", lifecycle.invalid_reason().alias("reason")
    )


@query("win_4", f"""with {LOG_SQL}, e as (
  select definition_id, pos, 'name' as field, case when value > 20 then 'n' || seq end as v from outcomes where action = 'edit' and outcome = 'applied'
  union all select definition_id, pos, 'confidence', case when value > 30 then 'high' else 'low' end from outcomes where action = 'edit' and outcome = 'applied')
select definition_id, field, max_by(v, pos) as value from e where v is not null group by 1, 2""")
def edits(spark, sf_dir):
    return lifecycle.edits(walked(spark, sf_dir))


@query("win_5", f"""with {LOG_SQL}, a as (select *, max(pos) over (partition by definition_id) as newest from outcomes where action = 'approve' and outcome = 'applied')
select definition_id, seq, actor as approved_by, pos = newest as is_current from a""")
def approvals(spark, sf_dir):
    return lifecycle.approval_history(walked(spark, sf_dir)).drop("at")


@query("stm_1", FOLD_SQL)
def incremental(spark, sf_dir):
    """The same log as a stream, folded trigger by trigger; must equal the batch fold."""
    schema = load(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    output = scratch_path(spark, "states")
    decisions.run_available(decisions.fold_stream(decision_log(events)), output, scratch_path(spark, "stream"))
    return with_text_times(decisions.newest_states(spark.read.parquet(output).drop("trigger")))


# ---- strict reading of responses built from the events ----

ENTITY = (
    "'{\"dimensions\": [{\"name\": \"n' || event_id || '\", \"display_name\": \"N\", \"description\": \"d\", "
    "\"source_column\": {\"table\": \"s.t\", \"column\": \"c\"}, \"cardinality_hint\": \"' || hint || '\", '"
)
TAIL = "\"confidence\": \"high\"}]}"
HINT = "case when value > 30 then 'low' when value > 20 then 'medium' when value > 3 then 'high' else 'tiny' end as hint"
RESPONSE = f"""case event_type
  when 'view' then {ENTITY} || '"rationale": "r", {TAIL}'
  when 'click' then '```json' || chr(10) || {ENTITY} || '"rationale": "r", "sample_values": [1, "x", null], {TAIL}' || chr(10) || '```'
  when 'error' then {ENTITY} || '{TAIL}'
  when 'signup' then {ENTITY} || '"rationale": "r", "colour": "red", {TAIL}'
  else 'Sorry, no proposals for ' || props end"""
JSN2_ERROR = """case when event_type = 'purchase' then 'unknown field: ' || props when event_type = 'signup' then 'unknown field'
  when event_type = 'error' then 'missing field' when hint = 'tiny' then 'bad cardinality_hint' end"""


@query("jsn_2", f"""with e as (select *, {HINT} from events), p as (select event_id as id, {JSN2_ERROR} as first_error, event_type from e)
select id, first_error is null as valid, first_error, case when event_type = 'purchase' then 0 else 1 end as n_items from p""")
def strict(spark, sf_dir):
    responses = load(spark, sf_dir, "events").selectExpr("*", HINT).select(F.col("event_id").alias("id"), F.expr(RESPONSE).alias("text"))
    read = validate.response_summary(validate.parse_responses(responses))
    return read.select("id", "valid", "first_error", F.col("n_items").cast("int").alias("n_items"))
