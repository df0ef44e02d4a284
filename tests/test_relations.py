import itertools
import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import profile, relations
from assayer.plans import propose
from assayer.session import cut


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_fuzzy_matches_against_all_pairs(frame, distance):
    """Most names share one block, which is the crowded case."""
    rng = random.Random(distance)
    name = lambda: "ACME" + "".join(rng.choice("AB") for _ in range(rng.randint(0, 5)))
    left, right = [name() for _ in range(60)] + ["ZETA"], [name() for _ in range(60)] + ["ZETAA", "ACM"]
    got = relations.fuzzy_matches(frame("n string", [(x,) for x in left]), "n", frame("m string", [(x,) for x in right]), "m", distance)
    found = {(r.left_canonical, r.right_canonical): (r.distance, r.left_n_rows, r.right_n_rows) for r in got.collect()}
    want = {
        (a, b): (edit_distance(a, b), left.count(a), right.count(b))
        for a, b in itertools.product(set(left), set(right)) if a[:4] == b[:4] and edit_distance(a, b) <= distance
    }
    assert found == want


@pytest.mark.parametrize("minimum", [1.0, 0.5])
def test_inclusions_against_all_pairs(frame, minimum):
    rng = random.Random(4)
    tables = {
        "parent": frame("id int, code string, word string", [(i, f"c{i}", rng.choice("xyz")) for i in range(20)]),
        "child": frame("ref int, code string, loose int", [(rng.randint(0, 19), f"c{rng.randint(0, 19)}", rng.randint(10, 30)) for _ in range(50)] + [(None, None, None)]),
    }
    columns = {(t, c): [r[c] for r in df.select(c).collect()] for t, df in tables.items() for c in df.columns}
    kinds = {(t, f.name): f.dataType.simpleString() for t, df in tables.items() for f in df.schema}
    want = {}
    for a, b in itertools.permutations(columns, 2):
        source, target = set(columns[a]) - {None}, columns[b]
        if kinds[a] == kinds[b] and None not in target and len(set(target)) == len(target) and source:
            share = len(source & set(target)) / len(source)
            if share >= minimum and source & set(target):
                want[a + b] = round(share, 6)
    values = profile.value_counts(tables, nulls=True)
    for profiles in (profile.value_profile(values), profile.profile(tables)):
        got = relations.inclusions(values.where("value is not null"), profiles, minimum).collect()
        assert {(r.from_table, r.from_column, r.to_table, r.to_column): r.containment for r in got} == want


def test_orphans_and_missing(frame):
    child = frame("k int, v string", [(1, "a"), (1, "b"), (9, "c"), (9, "d"), (8, "e"), (None, "f")])
    parent = frame("id int", [(1,), (2,), (2,)])
    assert tuple(relations.orphans(child, "k", parent, "id").first()) == (5, 3, 2, 0.6)
    assert sorted(r.v for r in relations.missing_counterparts(child, "k", parent, "id", "v <> 'e'").collect()) == ["c", "d", "f"]


def test_derived_links(frame):
    bank = frame("note string", [("WIRE PAYMENT X REF INV-2026-0001",), ("ACH PAYMENT X PARTIAL REF INV-2026-0009",), ("PAYROLL",), (None,)])
    invoices = frame("inv string, total int", [("INV-2026-0001", 5)])
    pattern = "REF (INV-[0-9]{4}-[0-9]{4})"
    assert tuple(relations.derived_links(bank, "note", pattern, invoices, "inv").first()) == (4, 2, 1)
    assert [r.total for r in relations.join_derived(bank, "note", pattern, invoices, "inv").collect()] == [5]


def test_cardinality(frame):
    a, b = frame("k int", [(1,), (2,), (3,)]), frame("k int", [(1,), (1,), (2,)])
    kind = lambda x, y: relations.link_cardinality(x, "k", y, "k").first().relationship_type
    assert kind(a, b) == "one_to_many" and kind(a, a) == "one_to_many" and kind(b, b) == "many_to_many"
    assert kind(a, frame("k int", [(7,)])) is None


def test_unlinked_dimension_with_hint(frame):
    tables = {
        "forecast": frame("segment string, owner string", [("Big", "ann"), ("Small", "bo"), ("Big", "bo")]),
        "plan": frame("business_unit string, owner string", [("Big", "ann"), ("Small", "ann"), ("Mid", "ann"), ("Mid", "x")]),
    }
    values = profile.value_counts(tables)
    dims = propose.dimensions(profile.profile(tables)).withColumn("base_name", propose.base_name(F.col("column_name")))
    columns = dims.select("table_name", "base_name")
    links = frame("from_table string, from_column string, to_table string, to_column string", [])
    found = lambda links: {r.from_column: (r.to_table, r.to_column) for r in relations.unlinked_dimensions(dims, columns, relations.value_overlaps(values), links).collect()}
    assert found(links) == {"segment": ("plan", "business_unit"), "business_unit": ("forecast", "segment")}
    # a column that has a relationship is linked; so is one whose name is a key elsewhere
    assert set(found(frame("from_table string, from_column string, to_table string, to_column string", [("forecast", "segment", "x", "y")]))) == {"business_unit"}
    columns = columns.unionByName(frame("table_name string, base_name string", [("units", "business_unit")]))
    assert set(found(links)) == {"segment"}


def test_decimal_and_boolean_columns_take_part(frame):
    tables = {
        "parent": frame("id int", [(i,) for i in range(5)]).selectExpr("cast(id as decimal(10,0)) as id", "id = 1 as flag"),
        "child": frame("ref int", [(1,), (3,), (3,)]).selectExpr("cast(ref as decimal(12,2)) as ref", "true as flag"),
    }
    values = profile.value_counts(tables)
    got = relations.inclusions(values, profile.profile(tables)).collect()
    assert [(r.from_column, r.to_column, r.n_values, r.n_matched, r.coverage) for r in got if r.from_table == "child"] == [("ref", "id", 2, 2, 0.4)]


def test_cardinalities_of_one_name(frame):
    tables = {"a": frame("x_id int, v int", [(1, 1), (1, 2), (2, 3)]), "b": frame("y_id int", [(1,), (1,)]), "c": frame("z_id int", [(2,)])}
    got = relations.cardinalities(profile.value_counts(tables), propose.base_name(F.col("column_name"))).collect()
    assert {(r.from_table, r.to_table): r.relationship_type for r in got} == {("a", "b"): "many_to_many", ("a", "c"): "one_to_many"}


def test_cardinalities_are_not_broadcast(frame, capsys):
    """The values of columns of one name grow with the tables."""
    tables = {t: frame("a_key int", [(i,) for i in range(9)]) for t in ("p", "q")}
    found = relations.cardinalities(cut(profile.value_counts(tables)), propose.base_name(F.col("column_name")))
    found.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    assert [(r.n_shared_keys, r.max_from, r.max_to) for r in found.collect()] == [(9, 1, 1)]


def test_confidence_needs_names_or_coverage(frame):
    df = frame("ratio double, coverage double, agree boolean", [(1.0, 0.1, True), (1.0, 0.95, False), (1.0, 0.5, False), (0.7, 0.5, True), (0.7, 1.0, False)])
    got = [r[0] for r in df.select(propose.confidence(F.col("ratio"), F.col("coverage"), F.col("agree"))).collect()]
    assert got == ["high", "high", "low", "medium", "low"]


def test_entity_groups_against_union_find(frame):
    rng = random.Random(9)
    nodes = [f"c{i:02d}" for i in range(60)]
    chain = [(nodes[i], nodes[i + 1]) for i in range(0, 24)]
    edges = chain + [(rng.choice(nodes[30:]), rng.choice(nodes[30:])) for _ in range(14)]
    group = {n: n for e in edges for n in e}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in edges:
        low, high = sorted([root(a), root(b)])
        group[high] = low
    df = frame("from_table string, from_column string, to_table string, to_column string", [("t", a, "t", b) for a, b in edges])
    got = {r["column"]: r.entity for r in propose.entity_groups(df).collect()}
    assert got == {f"t.{n}": f"t.{root(n)}" for n in group}


def test_entity_groups_of_long_chains(frame, monkeypatch):
    """Two ascending chains of 200 edges, joined at their far ends, in few rounds."""
    from assayer.operators import components

    cuts = []
    monkeypatch.setattr(components, "cut", lambda df, cut=components.cut: cuts.append(1) or cut(df))
    edges = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(200)] + [(f"b{i:03d}", f"b{i + 1:03d}") for i in range(200)] + [("a200", "b200")]
    df = frame("from_table string, from_column string, to_table string, to_column string", [("t", a, "t", b) for a, b in edges])
    assert {r.entity for r in propose.entity_groups(df).collect()} == {"t.a000"}
    assert len(cuts) <= 20


def test_entities_in_the_contracts_shape(frame):
    edges = frame(
        "from_table string, from_column string, to_table string, to_column string, evidence string, confidence string",
        [("orders", "o_custkey", "customer", "c_custkey", "all values", "high"), ("events", "user_id", "customer", "c_custkey", "some", "medium")])
    got = propose.entities(edges).first()
    assert (got.name, got.display_name, got.confidence, got.evidence) == ("cust", "Cust", "high", ["all values", "some"])
    assert [(c.table, c.column) for c in got.source_columns] == [("customer", "c_custkey"), ("events", "user_id"), ("orders", "o_custkey")]


def test_measures_quote_names(frame):
    df = frame("`net amount` double, plain double", [(1.0, 2.0), (1.0, 2.0)])
    names = {r.sql_expression for r in propose.measures(profile.profile({"t": df})).collect()}
    assert {"SUM(`net amount`)", "SUM(plain)"} <= names


def test_cardinalities_leave_out_names_of_one_table(frame, monkeypatch, capsys):
    """What no other table can share is not shuffled; the rest is merged, and only column names are broadcast."""
    tables = {"a": frame("o_key int, o_note string, o_day string", [(1, "x", "u"), (1, "y", "v"), (2, None, None)]),
              "b": frame("l_key int, l_day int, l_rate double, b_key int", [(1, 1, 0.5, 1), (2, 2, 0.5, 1)]), "c": frame("key string", [("1",)])}
    written = []
    kept = relations.cut
    monkeypatch.setattr(relations, "cut", lambda df: df.explain() or written.append(kept(df)) or written[-1])
    got = relations.cardinalities(profile.value_counts(tables), propose.base_name(F.col("column_name"))).collect()
    assert sorted(tuple(r) for r in got) == [("a", "o_key", "b", "b_key", 1, 2, 2, "many_to_many"), ("a", "o_key", "b", "l_key", 2, 2, 1, "one_to_many")]
    assert {(r.table_name, r.column_name) for r in written[-2].collect()} == {("a", "o_key"), ("b", "l_key"), ("b", "b_key")}
    joins = [line for line in capsys.readouterr().out.split("\n") if "Join" in line and "value#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
