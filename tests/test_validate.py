import json

import pytest
from pyspark.sql import functions as F

from assayer.operators import scope, validate
from assayer.sources import store
from assayer.vocab import CONFIDENCES

BASE = {"name": "n", "display_name": "N", "description": "d", "rationale": "r", "confidence": "high"}
REF = {"table": "s.t", "column": "c"}
GOOD = {
    "entities": {**BASE, "source_columns": [REF, REF], "evidence": ["e"]},
    "measures": {**BASE, "aggregation": "sum", "sql_expression": "SUM(x)", "source_tables": ["s.t"], "filter_expression": None, "format_hint": "percent", "caveats": []},
    "dimensions": {**BASE, "source_column": REF, "cardinality_hint": "low", "sample_values": ["a", 1, 1.5, True, None]},
    "time_dimensions": {**BASE, "source_column": REF, "granularity_hint": "day"},
    "relationships": {**BASE, "from_table": "a", "from_column": "b", "to_table": "c", "to_column": "d", "relationship_type": "derived"},
    "data_quality_flags": {"severity": "info", "title": "t", "description": "d", "rationale": "r", "affected_columns": []},
}


def changed(kind, drop=None, **more):
    item = {**GOOD[kind], **more}
    item.pop(drop, None)
    return json.dumps({kind: [item]})


CASES = [
    (json.dumps({k: [] for k in GOOD}), None),
    ("{}", None),
    *[(json.dumps({k: [v, v]}), None) for k, v in GOOD.items()],
    ("```json\n" + json.dumps({"entities": [GOOD["entities"]]}) + "\n```", None),
    ("not json at all", "not a JSON object: not json at all"),
    ("[]", "not a JSON object: []"),
    ('{"entities": []} {"entities": []}', 'not a JSON object: {"entities": []} {"entities": []}'),
    ('{"entities": [],}', 'not a JSON object: {"entities": [],}'),
    ('{"things": []}', 'unknown field: {"things": []}'),
    ('{"entities": "x"}', 'kind is not an array: {"entities": "x"}'),
    ('{"entities": [{"name": "x"}]}', "missing field"),
    ('{"entities": [5]}', "not an object"),
    (changed("entities", colour="red"), "unknown field"),
    (changed("entities", name=5), "bad name"),
    (changed("entities", source_columns=[]), "bad source_columns"),
    (changed("entities", source_columns=[REF, {"table": "t"}]), "bad source_columns"),
    (changed("entities", source_columns=[{**REF, "extra": 1}]), "bad source_columns"),
    (changed("entities", evidence=["a", None]), "bad evidence"),
    (changed("entities", evidence=None), "bad evidence"),
    (changed("entities", confidence="certain"), "bad confidence"),
    (changed("measures", aggregation="median"), "bad aggregation"),
    (changed("measures", source_tables=[]), "bad source_tables"),
    (changed("measures", format_hint=None), None),
    (changed("measures", format_hint="euro"), "bad format_hint"),
    (changed("dimensions", sample_values=list(range(11))), "bad sample_values"),
    (changed("dimensions", sample_values=[1, {"a": 1}]), "bad sample_values"),
    (changed("dimensions", source_column={"table": "t"}), "bad source_column"),
    (changed("time_dimensions", granularity_hint="hour"), "bad granularity_hint"),
    (changed("relationships", to_column=None), "one target side only"),
    (changed("relationships", to_column=None, to_table=None), "target needed"),
    (changed("relationships", drop="to_column", relationship_type="unlinked_dimension"), "one target side only"),
    (changed("relationships", to_column=None, to_table=None, relationship_type="unlinked_dimension"), None),
    (changed("relationships", relationship_type="unlinked_dimension"), None),
    (changed("data_quality_flags", drop="affected_columns"), None),
    (changed("data_quality_flags", severity="fatal"), "bad severity"),
]


def test_strict_parsing(frame):
    df = frame("id int, text string", [(i, t) for i, (t, _) in enumerate(CASES)])
    items = validate.parse_responses(df)
    got = {r.id: r for r in validate.response_summary(items).collect()}
    assert {i: got[i].first_error for i in got} == {i: e for i, (_, e) in enumerate(CASES)}
    assert all(got[i].valid is (e is None) for i, (_, e) in enumerate(CASES))
    assert got[0].n_items == 0 and got[2].entities == got[2].n_items == 2


def test_error_shows_the_first_500_characters(frame):
    row = validate.parse_responses(frame("id int, text string", [(1, "x" * 900)])).first()
    assert row.error == "not a JSON object: " + "x" * 500


def test_reasons(frame):
    df = frame("confidence string, tags array<string>", [("high", ["a"]), ("sure", ["a"]), (None, ["a"]), ("low", []), ("low", None), ("low", ["a"] * 11)])
    clean, rejected = validate.quarantine(df, validate.enum_reason({"confidence": CONFIDENCES}), validate.size_reason("tags", 1, 10))
    assert clean.count() == 1
    assert sorted(r.reason for r in rejected.collect()) == ["bad confidence"] * 2 + ["tags needs at least 1"] * 2 + ["tags takes at most 10"]


def test_target_rule(frame):
    df = frame("relationship_type string, to_table string, to_column string", [
        ("derived", "t", "c"), ("derived", None, None), ("derived", "t", None), ("unlinked_dimension", None, None), ("unlinked_dimension", "t", "c"), ("unlinked_dimension", None, "c"),
    ])
    assert [r[0] for r in df.select(validate.target_reason()).collect()] == [
        None, "target needed", "one target side only", None, None, "one target side only"
    ]


KNOWN = "snapshot_id string, schema_name string, table_name string, column_name string, column_id string"
REFS = "snapshot_id string, table string, column_name string"


def test_grounding(frame):
    known = frame(KNOWN, [("1", "s", "t", "a", "id-a")])
    references = frame(REFS, [("1", "s.t", "a"), ("1", "anything.s.t", "a"), ("1", "s.T", "a"), ("1", "s.t", "A"), ("2", "s.t", "a"), ("1", "t", "a")])
    resolved, lost = validate.ground(references, known, "quarantine")
    assert resolved.count() == 2 and lost.count() == 4
    with pytest.raises(validate.UngroundedReference):
        validate.ground(references, known)
    resolved, lost = validate.ground(references.limit(2), known)
    assert resolved.count() == 2


PROPOSALS = (
    "name string, display_name string, description string, rationale string, evidence array<string>, confidence string, proposed_at timestamp_ntz, "
    "prompt_version string, model string, source_snapshot_id string, scope_id string, source_columns array<struct<table:string,column:string>>"
)


def test_definitions_are_stored_additively(spark, frame, tmp_path):
    import datetime

    root, now = f"file://{tmp_path}/store", datetime.datetime(2026, 1, 1)
    row = lambda name, *columns: (name, name, "", "", [], "high", now, "v1", None, "1", None, [("s.t", c) for c in columns])
    known = frame(KNOWN, [("1", "s", "t", "a", "id-a"), ("1", "s", "t", "b", "id-b")])
    with pytest.raises(validate.UngroundedReference):
        store.persist_definitions(root, frame(PROPOSALS, [row("x", "a"), row("y", "nope")]), known)
    lost = store.persist_definitions(root, frame(PROPOSALS, [row("x", "a", "b"), row("y", "a", "nope")]), known, mode="quarantine")
    assert [r.column_name for r in lost.collect()] == ["nope"]
    store.persist_definitions(root, frame(PROPOSALS, [row("z", "b")]), known, "user:me")
    stored = store.read_table(spark, root, "definitions", store.DEFINITIONS_DDL)
    assert {(r.name, r.status, r.proposed_by) for r in stored.collect()} == {("x", "proposed", "system"), ("z", "proposed", "user:me")}
    links = store.read_table(spark, root, "definition_columns", store.LINKS_DDL)
    assert links.count() == 3 and links.join(stored, links.entity_id == stored.id, "left_anti").count() == 0
    with pytest.raises(ValueError):
        store.definition_rows(frame(PROPOSALS, []), "someone")


TABLES = "schema_name string, table_name string"


def test_scopes(frame):
    tables = frame(TABLES, [("sales", "a"), ("sales", "b"), ("ref", "a"), ("hr", "c")])
    kept = lambda *args: sorted(map(tuple, scope.apply_scope(tables, *args).collect()))
    assert kept(["sales", "ref"], ["sales.a"]) == [("ref", "a"), ("sales", "b")]
    assert kept(["sales"], frame("x string", [("sales.b",)])) == [("sales", "a")]
    assert kept(["hr"]) == [("hr", "c")]
    scope.validate_scope(["sales", "hr"], tables, ["hr.c"])
    with pytest.raises(scope.InvalidScope, match="must not be empty"):
        scope.validate_scope([], tables)
    with pytest.raises(scope.InvalidScope, match=r"\['SALES', 'nope'\]"):
        scope.validate_scope(["sales", "nope", "SALES"], tables)
    with pytest.raises(scope.InvalidScope, match="hr.zz"):
        scope.validate_scope(["hr"], tables, ["hr.zz"])


def test_reference_counts(frame):
    got = scope.reference_counts(
        frame("id int", [(1,), (2,)]), "id", {"snapshots": (frame("scope int", [(1,), (1,)]), "scope"), "definitions": (frame("scope int", []), "scope")}
    ).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 2, 0, False), (2, 0, 0, True)]


def test_confidence_order(frame):
    got = frame("c string", [("low",), ("high",), ("medium",)]).orderBy(F.desc(validate.confidence_rank(F.col("c")))).collect()
    assert [r.c for r in got] == ["high", "medium", "low"]
