"""The union of all proposals on tables of their own."""

import datetime

import pytest
from pyspark.sql import functions as F

from assayer.operators import profile
from assayer.plans import bindings  # noqa: F401, registers the queries
from assayer.plans.bindings.base import QUERIES, TABLES, fields
from assayer.plans.bindings.proposals import KINDS

TYPES = {"integer": "bigint", "numeric": "double", "string": "string", "timestamp": "timestamp", "json": "array<float>"}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Twelve rows a table; the first column is a key, other whole numbers repeat, texts are written in two ways."""
    folder = tmp_path_factory.mktemp("small")

    def value(kind, i, column):
        return {"integer": i, "numeric": i * 1.5, "timestamp": datetime.datetime(2024, 1, 1 + i), "json": [float(i), 1.0],
                "string": f"{'Steel' if i % 2 else 'STEEL'} {column[2:]} {i // 2}"}[kind]

    for t in TABLES:
        rows = [tuple(value(k, i % 4 if n and k == "integer" else i, c) for n, (c, k) in enumerate(fields(t))) for i in range(12)]
        spark.createDataFrame(rows, ", ".join(f"{c} {TYPES[k]}" for c, k in fields(t))).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_checks_are_not_one_plan(spark, small):
    found = QUERIES["prp_6"](spark, small)
    assert exchanges(found) == 0  # every check is worked out by itself
    assert {r.title for r in found.select("title").distinct().collect()} >= {"Several spellings of a name", "Empty table"}


def test_kinds_are_not_one_plan(spark, small, monkeypatch):
    profiled = []
    whole = profile.profile
    monkeypatch.setattr(profile, "profile", lambda tables, *a, **k: profiled.append(len(tables)) or whole(tables, *a, **k))
    found = QUERIES["set_5"](spark, small)
    assert exchanges(found) == 0
    assert profiled.count(len(TABLES)) == 1  # one profile for all kinds
    counted = {r.kind: r.n for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    for kind, name, table, *_ in KINDS:
        if name in ("prp_2", "prp_3", "prp_4", "prp_6"):
            assert counted.get(kind, 0) == QUERIES[name](spark, small).count()
    assert counted["measure"] >= len(TABLES)
