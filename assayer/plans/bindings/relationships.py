"""Links between columns of the given tables, and what is proposed from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from assayer.operators import discovery, profile, relations
from assayer.plans import propose
from assayer.plans.bindings.base import described, load, load_all, profile_sql, query, union_sql, value_sql, values_sql
from assayer.plans.bindings.inventory import CANONICAL_SQL
from assayer.session import cut

LINK_TYPES = ("integer", "numeric", "boolean", "string", "date", "timestamp")

# The orders as another system keeps them: numbers as decimals of different scale, and a flag.
LEDGERS = {
    "ledger_orders": (
        "select cast(o_orderkey as decimal(20,2)) as order_no, cast(o_totalprice as decimal(18,4)) as amount, "
        "o_orderstatus = 'F' as is_closed from orders",
        [("order_no", "numeric"), ("amount", "numeric"), ("is_closed", "boolean")]),
    "ledger_lines": (
        "select cast(l_orderkey as decimal(14,0)) as order_no, l_linestatus = 'F' as is_closed from lineitem",
        [("order_no", "numeric"), ("is_closed", "boolean")]),
    # names and numbers as they stand in other systems: shortened, with a designator, inside a sentence
    "catalog": ("select left(upper(replace(p_name, ' ', '')), length(p_name) - 2) as title from part", [("title", "string")]),
    "shop": ("select p_name || ' Ltd.' as product from part", [("product", "string")]),
    "billing": (
        "select 'INV-' || year(o_orderdate) || '-' || lpad(cast(o_orderkey as varchar), 8, '0') as invoice_no from orders",
        [("invoice_no", "string")]),
    "bank": (
        "select 'Transfer for INV-' || year(o_orderdate) || '-' || lpad(cast(o_orderkey as varchar), 8, '0') || ' received' as description "
        "from orders where o_orderstatus = 'F'", [("description", "string")]),
}
PROFILE_SQL, VALUES_SQL = profile_sql(extra=LEDGERS), values_sql(LINK_TYPES, extra=LEDGERS)


def link_inputs(spark, sf_dir):
    """The tables, distinct values of every column that has comparable ones, whole texts included, and what they tell of it."""
    tables = load_all(spark, sf_dir)
    orders, lines = tables["orders"], tables["lineitem"]
    tables["ledger_orders"] = orders.selectExpr(
        "cast(o_orderkey as decimal(20,2)) as order_no", "cast(o_totalprice as decimal(18,4)) as amount", "o_orderstatus = 'F' as is_closed")
    tables["ledger_lines"] = lines.selectExpr("cast(l_orderkey as decimal(14,0)) as order_no", "l_linestatus = 'F' as is_closed")
    tables["catalog"] = tables["part"].selectExpr("left(upper(replace(p_name, ' ', '')), length(p_name) - 2) as title")
    tables["shop"] = tables["part"].selectExpr("p_name || ' Ltd.' as product")
    invoice = "'INV-' || year(o_orderdate) || '-' || lpad(cast(o_orderkey as string), 8, '0')"
    tables["billing"] = orders.selectExpr(f"{invoice} as invoice_no")
    tables["bank"] = orders.where("o_orderstatus = 'F'").selectExpr(f"'Transfer for ' || {invoice} || ' received' as description")
    columns = {t: [c for c, k in kinds if k in LINK_TYPES] for t, _, kinds in described(None, LEDGERS)}
    # both are used several times over
    counted = cut(profile.value_counts(tables, columns, nulls=True))
    return tables, counted.where("value is not null"), cut(profile.value_profile(counted))


class Links:
    """What relationship and entity proposals are made from, each part worked out once."""

    def __init__(self, spark, sf_dir):
        self.tables, self.values, self.profiles = link_inputs(spark, sf_dir)
        self.found = cut(relations.inclusions(self.values, self.profiles))
        self.inside = cut(discovery.reference_links(self.tables, self.values, self.profiles))
        self.close = cut(discovery.fuzzy_links(self.values))


def inclusions_sql(minimum: float) -> str:
    """CTE `incl`; without pruning, since pruning may not change the answer."""
    return f"""{PROFILE_SQL}, {VALUES_SQL},
sized as (select table_name, column_name, count(*) as n_values from vals group by 1, 2),
held as (select v.*, p.n_distinct as n_keys from vals v join prof p on p.table_name = v.table_name and p.column_name = v.column_name and p.is_key),
incl as (
  select a.table_name as from_table, a.column_name as from_column, b.table_name as to_table, b.column_name as to_column,
         max(s.n_values) as n_values, count(*) as n_matched, round(count(*) / max(s.n_values), 6) as containment,
         round(count(*) / max(b.n_keys), 6) as coverage
  from vals a join held b on a.value = b.value and a.normalized_type = b.normalized_type
       and (a.table_name <> b.table_name or a.column_name <> b.column_name)
  join sized s on s.table_name = a.table_name and s.column_name = a.column_name
  group by 1, 2, 3, 4 having round(count(*) / max(s.n_values), 6) >= {minimum})"""


@query("jn_4", f"with {inclusions_sql(1.0)} select * from incl")
def inclusions(spark, sf_dir):
    _, values, profiles = link_inputs(spark, sf_dir)
    return relations.inclusions(values, profiles)


ORPHANS = [
    ("documents", "doc_id", "labels", "doc_id"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_custkey", "events", "user_id"),
]


@query("jn_5", union_sql(
    f"select '{c}.{k}' as child, '{p}.{q}' as parent, count({k}) as n_rows, count(*) filter (where x is null) as n_orphan_rows, "
    f"count(distinct case when x is null then {k} end) as n_orphan_keys, round(count(*) filter (where x is null) / count({k}), 6) as orphan_ratio "
    f"from (select c.{k}, p.x from {c} c left join (select distinct {q} as x from {p}) p on c.{k} = p.x where c.{k} is not null)"
    for c, k, p, q in ORPHANS
))
def orphans(spark, sf_dir):
    return reduce(DataFrame.unionByName, [
        relations.orphans(load(spark, sf_dir, c), k, load(spark, sf_dir, p), q).select(
            F.lit(f"{c}.{k}").alias("child"), F.lit(f"{p}.{q}").alias("parent"), "*"
        )
        for c, k, p, q in ORPHANS
    ])


@query("jn_6", """select o_orderkey, o_custkey, o_totalprice from orders o where o_orderstatus = 'F'
and not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)""")
def missing(spark, sf_dir):
    lost = relations.missing_counterparts(
        load(spark, sf_dir, "orders"), "o_orderkey", load(spark, sf_dir, "lineitem"), "l_orderkey", "o_orderstatus = 'F'"
    )
    return lost.select("o_orderkey", "o_custkey", "o_totalprice")


# one character short, upper case, no blank
VARIANT = "left(upper(replace(p_name, ' ', '')), length(p_name) - 2)"
BLOCK = "left(upper(regexp_replace({0}, '[^A-Za-z]', '', 'g')), 4)"
CANON = "upper(replace({0}, ' ', ''))"  # these names hold no punctuation and no designators
FUZZY_SQL = f"""l as (select {BLOCK.format("p_name")} as block, {CANON.format("p_name")} as canonical, count(distinct p_name) as n_spellings,
  count(*) as n_rows from part group by 1, 2),
r as (select {BLOCK.format("v")} as block, {CANON.format("v")} as canonical, count(distinct v) as n_spellings, count(*) as n_rows
  from (select {VARIANT} as v from part) group by 1, 2),
fuzzy as (select l.block, l.canonical as left_canonical, r.canonical as right_canonical, levenshtein(l.canonical, r.canonical) as distance,
  l.n_rows as left_n_rows, r.n_rows as right_n_rows, r.n_spellings as right_n_spellings
  from l join r on l.block = r.block where levenshtein(l.canonical, r.canonical) <= 2)"""


def fuzzy(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return relations.fuzzy_matches(part, "p_name", part, F.expr(VARIANT), max_distance=2)


@query("jn_7", f"with {FUZZY_SQL} select * from fuzzy")
def fuzzy_names(spark, sf_dir):
    return fuzzy(spark, sf_dir).select(
        "block", "left_canonical", "right_canonical", F.col("distance").cast("bigint").alias("distance"), "left_n_rows", "right_n_rows", "right_n_spellings"
    )


CUSTOMER_NUMBER = "#0*([0-9]+)$"


@query("jn_8", f"""with e as (select try_cast(nullif(regexp_extract(c_name, '{CUSTOMER_NUMBER}', 1), '') as bigint) as k from customer)
select count(*) as n_rows, count(k) as n_extracted, count(o.x) as n_linked from e left join (select distinct o_custkey as x from orders) o on o.x = e.k""")
def derived(spark, sf_dir):
    return relations.derived_links(
        load(spark, sf_dir, "customer"), "c_name", CUSTOMER_NUMBER, load(spark, sf_dir, "orders"), "o_custkey", key_type="bigint"
    )


LINKS = [
    ("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("events", "user_id", "orders", "o_custkey"), ("documents", "doc_id", "labels", "doc_id"), ("supplier", "s_nationkey", "customer", "c_nationkey"),
]


@query("jn_9", union_sql(
    f"select '{a}.{x}' as left_column, '{b}.{y}' as right_column, count(*) as n_shared_keys, max(a.n) as max_left, max(b.n) as max_right, "
    f"case when max(a.n) > 1 and max(b.n) > 1 then 'many_to_many' when count(*) > 0 then 'one_to_many' end as relationship_type "
    f"from (select {x} as k, count(*) as n from {a} group by 1) a join (select {y} as k, count(*) as n from {b} group by 1) b on a.k = b.k"
    for a, x, b, y in LINKS
))
def cardinality(spark, sf_dir):
    return reduce(DataFrame.unionByName, [
        relations.link_cardinality(load(spark, sf_dir, a), x, load(spark, sf_dir, b), y).select(
            F.lit(f"{a}.{x}").alias("left_column"), F.lit(f"{b}.{y}").alias("right_column"), "*"
        )
        for a, x, b, y in LINKS
    ])


TEXT_COLUMNS = [(t, relation, c) for t, relation, kinds in described(None, LEDGERS) for c, k in kinds if k == "string"]
NAMES_SQL = f"""texts as ({union_sql(
    f"select distinct '{t}' as t, '{c}' as c, {c} as v from {relation} where {c} is not null and length({c}) <= 128" for t, relation, c in TEXT_COLUMNS)}),
names as (select distinct t, c, {BLOCK.format("v")} as block, {CANONICAL_SQL.format("v")} as canonical from texts
  where length({BLOCK.format("v")}) = 4 and {CANONICAL_SQL.format("v")} is not null)"""
# without sketches: every pair of columns, name by name
LOOSE_SQL = f"""{NAMES_SQL},
counted_names as (select t, c, count(*) as n_names from names group by 1, 2),
met as (select a.t as ft, a.c as fc, b.t as tt, b.c as tc, count(distinct a.block || a.canonical) as n_matched
  from names a join names b on a.block = b.block and (a.t <> b.t or a.c <> b.c) and levenshtein(a.canonical, b.canonical) <= 1 group by 1, 2, 3, 4),
shares as (select met.*, n_names, round(n_matched / n_names, 6) as share from met join counted_names k on k.t = ft and k.c = fc
  where round(n_matched / n_names, 6) >= 0.5),
same as (select a.table_name as ft, a.column_name as fc, b.table_name as tt, b.column_name as tc, count(*) as n_same
  from vals a join vals b on a.value = b.value and a.normalized_type = b.normalized_type group by 1, 2, 3, 4),
written as (select table_name, column_name, count(*) as n_values from vals group by 1, 2),
whole as (select ft, fc, tt, tc from same join written on table_name = ft and column_name = fc where n_same = n_values),
uneven as (select s.* from shares s left join whole w on w.ft = s.ft and w.fc = s.fc and w.tt = s.tt and w.tc = s.tc where w.ft is null),
ranked_loose as (select *, row_number() over (partition by least(ft || '.' || fc, tt || '.' || tc), greatest(ft || '.' || fc, tt || '.' || tc)
    order by share desc, ft, fc, tt, tc) as rn from uneven),
loose as (select ft as from_table, fc as from_column, tt as to_table, tc as to_column, n_names, n_matched, share from ranked_loose where rn = 1)"""


@query("jn_7_discovery", f"with {VALUES_SQL}, {LOOSE_SQL} select * from loose")
def names_spelled_differently(spark, sf_dir):
    _, values, _ = link_inputs(spark, sf_dir)
    return discovery.fuzzy_links(values)


TOKENS = discovery.TOKEN
LABEL = "lower(regexp_extract(token, '^([A-Za-z]*)', 1))"
INSIDE_SQL = f"""tokens as ({union_sql(
    f"select '{t}' as t, '{c}' as c, token, count(*) as n from (select unnest(list_distinct(regexp_extract_all({c}, '{TOKENS}'))) as token from {relation}) "
    f"where regexp_matches(token, '[0-9]') group by 3" for t, relation, c in TEXT_COLUMNS)}),
shaped as (select *, regexp_replace(regexp_replace(token, '[A-Za-z]+', 'A', 'g'), '[0-9]+', '9', 'g') as shape from tokens),
refs as (select t, c, shape, token as reference, 'string' as kind, sum(n) as n, min({LABEL}) as label, max({LABEL}) as last_label
    from shaped group by 1, 2, 3, 4
  union all select t, c, shape, regexp_replace(regexp_extract(token, '([0-9]+)$', 1), '^0+([0-9])', '\\1'), 'integer', sum(n),
    min({LABEL}), max({LABEL}) from shaped
    where regexp_matches(token, '[0-9]$') group by 1, 2, 3, 4),
common as (select t, c, shape, kind, sum(n) as n_rows, count(*) as n_references, min(label) as label, max(last_label) as last_label from refs join prof on table_name = t and column_name = c
  group by 1, 2, 3, 4 having sum(n) >= 0.5 * max(prof.n_rows - prof.n_nulls)),
hits as (select r.t, r.c, r.shape, r.kind, v.table_name, v.column_name, count(*) as n_linked
  from refs r join common k on k.t = r.t and k.c = r.c and k.shape = r.shape and k.kind = r.kind
  join vals v on v.value = r.reference and v.normalized_type = r.kind and (v.table_name <> r.t or v.column_name <> r.c) group by 1, 2, 3, 4, 5, 6),
inside as (select h.t as from_table, h.c as from_column, h.shape, h.table_name as to_table, h.column_name as to_column,
    cast(k.n_rows as bigint) as n_rows, k.n_references, n_linked, p.n_distinct as n_keys
  from hits h join common k on k.t = h.t and k.c = h.c and k.shape = h.shape and k.kind = h.kind
  join prof p on p.table_name = h.table_name and p.column_name = h.column_name
  where p.n_distinct > 1 and n_linked >= 0.9 * k.n_references and n_linked >= case when h.kind = 'integer' then 0.5 * p.n_distinct else 1 end
    and (h.kind = 'string' or length(k.label) >= 3 and k.label = k.last_label and contains(h.table_name || '.' || h.column_name, left(k.label, 4))))"""


@query("jn_8_discovery", f"with {PROFILE_SQL}, {VALUES_SQL}, {INSIDE_SQL} select * from inside")
def references_in_texts(spark, sf_dir):
    tables, values, profiles = link_inputs(spark, sf_dir)
    return discovery.reference_links(tables, values, profiles)


UNLINKED_SQL = f"""dims as (select table_name, column_name, regexp_replace(column_name, '^[a-z]{{1,2}}_', '') as base_name from prof
  where not is_key and n_distinct > 0 and normalized_type in ('string', 'boolean', 'integer') and cardinality in ('low', 'medium')),
alone as (select regexp_replace(column_name, '^[a-z]{{1,2}}_', '') as base_name from prof group by 1 having count(distinct table_name) = 1),
homes as (select dims.* from dims join alone on alone.base_name = dims.base_name),
dv as (select v.* from vals v join dims d on d.table_name = v.table_name and d.column_name = v.column_name),
overlap as (select a.table_name as ft, a.column_name as fc, b.table_name as tt, b.column_name as tc, count(*) as m
  from dv a join dv b on a.value = b.value and a.normalized_type = b.normalized_type and (a.table_name <> b.table_name or a.column_name <> b.column_name)
  group by 1, 2, 3, 4),
sizes as (select table_name, column_name, count(*) as n from dv group by 1, 2),
hints as (select ft, fc, tt, tc, row_number() over (partition by ft, fc order by round(m / n, 6) desc, tt desc, tc desc) as rn
  from overlap join sizes on table_name = ft and column_name = fc),
unlinked as (select h.table_name as from_table, h.column_name as from_column, tt as to_table, tc as to_column, 'unlinked_dimension' as relationship_type
  from homes h left join hints on ft = h.table_name and fc = h.column_name and rn = 1)"""


def named_links(found: DataFrame) -> DataFrame:
    """Inclusions whose bare names agree."""
    return found.where(propose.base_name(F.col("from_column")) == propose.base_name(F.col("to_column")))


def unlinked(values: DataFrame, profiles: DataFrame, links: DataFrame) -> DataFrame:
    name = propose.base_name(F.col("column_name"))
    dims = propose.dimensions(profiles).withColumn("base_name", name)
    few = values.join(dims.select("table_name", "column_name"), ["table_name", "column_name"], "left_semi")
    columns = profiles.select("table_name", name.alias("base_name"))
    return relations.unlinked_dimensions(dims, columns, relations.value_overlaps(few), links)


@query("jn_10", f"with {PROFILE_SQL}, {VALUES_SQL}, {UNLINKED_SQL} select * from unlinked")
def unlinked_dimensions(spark, sf_dir):
    _, values, profiles = link_inputs(spark, sf_dir)
    return unlinked(values, profiles, named_links(relations.inclusions(values, profiles)))


AGREE = "regexp_replace(from_column, '^[a-z]{1,2}_', '') = regexp_replace(to_column, '^[a-z]{1,2}_', '')"
@query("prp_1", f"""with recursive {inclusions_sql(1.0)}, {INSIDE_SQL}, {LOOSE_SQL},
links as (select from_table || '.' || from_column as x, to_table || '.' || to_column as y,
    'all ' || n_values || ' values of ' || from_table || '.' || from_column || ' are in ' || to_table || '.' || to_column as evidence,
    'high' as confidence from incl where {AGREE}
  union all select from_table || '.' || from_column, to_table || '.' || to_column,
    n_linked || ' of ' || n_references || ' references in ' || from_table || '.' || from_column || ' are in ' || to_table || '.' || to_column,
    case when n_linked = n_references then 'high' else 'medium' end from inside
  union all select from_table || '.' || from_column, to_table || '.' || to_column,
    n_matched || ' of ' || n_names || ' names in ' || from_table || '.' || from_column || ' are close to names in ' || to_table || '.' || to_column,
    'medium' from loose),
edges as (select x, y from links union select y, x from links),
reach as (select x, y from edges union select r.x, e.y from reach r join edges e on e.x = r.y),
roots as (select x, least(x, min(y)) as entity from reach group by x),
members as (select entity, string_agg(x, ', ' order by x) as members from roots group by 1),
shown as (select entity, string_agg(distinct evidence, '; ' order by evidence) as evidence, max(case confidence when 'high' then 3 else 2 end) as rank
  from links join roots on roots.x = links.x group by 1),
named as (select *, regexp_replace(regexp_replace(split_part(m.entity, '.', 2), '^[a-z]{{1,2}}_', ''), '_?(key|id)$', '') as short from members m join shown s on s.entity = m.entity),
final as (select case when short = '' then replace(entity, '.', '_') else short end as name, * from named)
select name, 'What ' || members || ' refer to.' as description, members as source_columns, evidence, case rank when 3 then 'high' else 'medium' end as confidence from final""")
def entities(spark, sf_dir):
    """Columns tied by inclusions whose names agree, by references inside texts, and by names spelled differently."""
    return entity_rows(Links(spark, sf_dir))


def entity_rows(links: Links) -> DataFrame:
    named = named_links(links.found)
    place = [F.concat_ws(".", f"{side}_table", f"{side}_column") for side in ("from", "to")]
    held = named.select(
        "from_table", "from_column", "to_table", "to_column",
        F.concat(F.lit("all "), F.col("n_values").cast("string"), F.lit(" values of "), place[0], F.lit(" are in "), place[1]).alias("evidence"),
        F.lit("high").alias("confidence"))
    def shown(count: str, total: str, what: str, relation: str):
        return F.concat(F.col(count).cast("string"), F.lit(" of "), F.col(total).cast("string"), F.lit(f" {what} in "), place[0], F.lit(f" {relation} "), place[1])

    ends = ["from_table", "from_column", "to_table", "to_column"]
    inside = links.inside.select(
        *ends, shown("n_linked", "n_references", "references", "are in").alias("evidence"),
        F.when(F.col("n_linked") == F.col("n_references"), "high").otherwise("medium").alias("confidence"))
    close = links.close.select(
        *ends, shown("n_matched", "n_names", "names", "are close to names in").alias("evidence"), F.lit("medium").alias("confidence"))
    proposed = propose.entities(cut(held.unionByName(inside).unionByName(close)))
    members = F.transform("source_columns", lambda c: F.concat_ws(".", c["table"], c["column"]))
    return proposed.select("name", "description", F.array_join(members, ", ").alias("source_columns"),
                           F.array_join("evidence", "; ").alias("evidence"), "confidence")


CONFIDENCE = f"""case when containment >= 1.0 and ({AGREE} or coverage >= 0.9) then 'high' when {AGREE} then 'medium' else 'low' end"""
COUNTED_SQL = "counted as (" + union_sql(
    f"select '{t}' as table_name, '{c}' as column_name, '{k}' as normalized_type, {value_sql(c, k)} as value, count(*) as n from {relation} where {c} is not null group by 4"
    for t, relation, kinds in described(None, LEDGERS) for c, k in kinds if k in LINK_TYPES) + """),
cards as (select a.table_name as from_table, a.column_name as from_column, b.table_name as to_table, b.column_name as to_column,
    case when max(a.n) > 1 and max(b.n) > 1 then 'many_to_many' else 'one_to_many' end as relationship_type
  from counted a join counted b on a.value = b.value and a.normalized_type = b.normalized_type and a.table_name < b.table_name
    and regexp_replace(a.column_name, '^[a-z]{1,2}_', '') = regexp_replace(b.column_name, '^[a-z]{1,2}_', '')
  group by 1, 2, 3, 4)"""


@query("prp_5", f"""with {inclusions_sql(1.0)}, {UNLINKED_SQL}, {COUNTED_SQL}, {INSIDE_SQL}, {LOOSE_SQL}
select from_table, from_column, to_table, to_column, 'exact_match' as relationship_type, {CONFIDENCE} as confidence from incl
union all select from_table, from_column, to_table, to_column, relationship_type, 'medium' from unlinked
union all select from_table, from_column, to_table, to_column, relationship_type, 'high' from cards
union all select from_table, from_column, to_table, to_column, 'derived', case when n_linked = n_references then 'high' else 'medium' end from inside
union all select from_table, from_column, to_table, to_column, 'fuzzy_match', 'medium' from loose""")
def relationship_proposals(spark, sf_dir):
    return relationship_rows(Links(spark, sf_dir))


def relationship_rows(links: Links) -> DataFrame:
    found, values, profiles = links.found, links.values, links.profiles
    # column names; each is written before the next is planned, so that the driver holds one plan and its jobs at a time
    loose = cut(unlinked(values, profiles, named_links(found)).withColumn("confidence", F.lit("medium")))
    cards = cut(relations.cardinalities(values.where(F.col("normalized_type").isin(*LINK_TYPES)), propose.base_name(F.col("column_name"))).withColumn("confidence", F.lit("high")))
    inside = links.inside.withColumns({
        "relationship_type": F.lit("derived"), "confidence": F.when(F.col("n_linked") == F.col("n_references"), "high").otherwise("medium")})
    close = links.close.withColumns({"relationship_type": F.lit("fuzzy_match"), "confidence": F.lit("medium")})
    return propose.relationships(propose.exact_relationships(found), loose, cards, inside, close)


@query("prp_7", f"with {inclusions_sql(0.5)} select from_table, from_column, to_table, to_column, containment, {CONFIDENCE} as confidence from incl")
def confidences(spark, sf_dir):
    _, values, profiles = link_inputs(spark, sf_dir)
    partial = relations.inclusions(values, profiles, minimum=0.5)
    agree = propose.base_name(F.col("from_column")) == propose.base_name(F.col("to_column"))
    return partial.select(
        "from_table", "from_column", "to_table", "to_column", "containment",
        propose.confidence(F.col("containment"), F.col("coverage"), agree).alias("confidence"),
    )
