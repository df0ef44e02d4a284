"""A small warehouse with every kind of planted problem, at fixed dates."""

import datetime
import math
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from assayer.functions.text import extract_reference
from assayer.operators import measures, profile, quality, reconcile, relations

d = datetime.date


@pytest.fixture(scope="module")
def wh(spark):
    make = lambda ddl, rows: spark.createDataFrame(rows, ddl)
    deals = [
        (f"OPP-{i}", f"Customer {i % 4}", "Closed Won" if i % 2 else "Proposal", D(1000 * i), None if i == 3 else 12 if i % 3 else 24, None if i == 5 else D(1000 * i))
        for i in range(1, 11)
    ]
    invoices = [(f"INV-2026-000{i}", f"OPP-{i}", d(2026, i, 1), D(1000 * i), D(80 * i), D(1080 * i)) for i in (1, 3, 5, 7)]
    bank = [
        ("T1", "ACH PAYMENT C PARTIAL REF INV-2026-0001", D("648.00")), ("T2", "ACH PAYMENT C FINAL REF INV-2026-0001", D("432.00")),
        ("T3", "WIRE PAYMENT C REF INV-2026-0003", D("3740.00")), ("T4", "CREDIT REFUND C REF INV-2026-0003", D("-500.00")),
        ("T5", "CHECK PAYMENT C REF INV-2026-0005", D("5400.00")), ("T6", "REFUND - UNMATCHED", D("-1250.00")), ("T7", "PAYROLL EXPENSE", D("-900.00")),
    ]
    return {
        "deals": make("opp_id string, account string, stage string, amount decimal(12,2), months int, arr decimal(12,2)", deals),
        "invoices": make("inv string, opp_id string, inv_date date, subtotal decimal(12,2), tax decimal(12,2), total decimal(12,2)", invoices),
        "bank": make("txn string, note string, amount decimal(12,2)", bank),
        "legacy": make("id int, status string", [(1, "Active"), (2, "ACTIVE"), (3, "A"), (4, "Inactive"), (5, "I"), (6, "I")]),
        "codes": make("code string", [("A",), ("I",), ("P",)]),
        "old": make("id int", []),
        "flags": make("config string, label string", [('{"a": 1}', "12"), ("[1]", "x"), (None, "{bad")]),
        "forecast": make("month date, segment string, amount decimal(14,2), churn double, ltv double", [(d(2026, m, 1), "SMB", D(115 if m < 4 else 100), 0.1, 115 * 12 / 0.1 if m < 4 else 100 * 12 / 0.1) for m in range(1, 7)]),
        "plan": make("quarter string, unit string, planned decimal(14,2), version int", [("2026-Q1", "SMB", D(300), 1), ("2026-Q1", "SMB", D(330), 2), ("2026-Q2", "SMB", D(300), 1)]),
    }


def test_null_rates(wh):
    got = {(r.column_name, r.measured) for r in quality.null_rates(profile.profile({"deals": wh["deals"]}), 0.05).collect()}
    assert got == {("months", 0.1), ("arr", 0.1)}


def test_won_deals_without_invoice(wh):
    lost = relations.missing_counterparts(wh["deals"], "opp_id", wh["invoices"], "opp_id", "stage = 'Closed Won'")
    assert [r.opp_id for r in lost.collect()] == ["OPP-9"]


def settled(wh):
    paid = reconcile.receipts(wh["bank"], extract_reference(F.col("note")), "amount")
    return reconcile.settlements(wh["invoices"], "inv", "total", paid)


def test_settlements(wh):
    all_of = settled(wh)
    assert {r.reference[-1]: r.status for r in all_of.collect()} == {"1": "exact", "3": "exact", "5": "exact", "7": "unpaid"}
    assert [r.reference for r in reconcile.split_payments(all_of).collect()] == ["INV-2026-0001"]
    wrong = reconcile.corrected_payments(all_of).collect()
    assert [(r.reference, r.gross, r.credited) for r in wrong] == [("INV-2026-0003", D("3740.00"), D("-500.00"))]


def test_unattributed_refund(wh):
    got = reconcile.unattributed(
        wh["bank"], extract_reference(F.col("note")), "amount", wh["invoices"], "inv", F.col("note").endswith("EXPENSE")
    )
    assert [r.txn for r in got.collect()] == ["T6"]


def test_codes(wh):
    assert {(r.code, r.n_spellings, r.n_rows) for r in quality.code_variants(wh["legacy"], "status").collect()} == {("ACTIVE", 3, 3), ("INACTIVE", 2, 3)}
    unknown = quality.outside_domain(wh["legacy"], "status", wh["codes"], "code").collect()
    assert {r.value for r in unknown} == {"Active", "ACTIVE", "Inactive"}


def test_codes_that_only_begin_alike_are_apart(frame):
    df = frame("s string", [("Active",), ("Archived",), ("Approved",), ("A",), ("AC",), ("active",)])
    assert {(r.code, r.n_spellings) for r in quality.code_variants(df, "s").collect()} == {("ACTIVE", 3)}


def test_formulas(wh):
    assert quality.formula_violations(wh["invoices"], "total", "subtotal + tax").first().n_violations == 0
    ltv = quality.formula_violations(wh["forecast"], "ltv", "amount / churn", 0.01).first()
    assert (ltv.n_violations, ltv.median_factor) == (6, 12.0)


def test_empty_frozen_and_json(wh, spark):
    counts = spark.createDataFrame([("old", 0), ("deals", 10)], "table_name string, row_count bigint")
    assert [r.table_name for r in quality.empty_tables(counts).collect()] == ["old"]
    stale = quality.staleness(wh["invoices"], "invoices", "inv_date", "2026-12-31").first()
    assert (stale.newest, stale.single_year, stale.before_cutoff) == ("2026-07-01", True, True)
    assert tuple(quality.json_share(wh["flags"], "config").first()) == (2, 2, 1.0)
    assert tuple(quality.json_share(wh["flags"], "label").first()) == (3, 0, 0.0)


def test_name_collision(wh):
    tables = {"deals": wh["deals"].select("amount"), "bank": wh["bank"].select((F.col("amount") - 1_000_000).alias("amount")), "x": wh["legacy"].select("id")}
    got = quality.name_collisions(profile.profile(tables), F.col("column_name")).collect()
    assert [(r.base_name, r.n_tables, r.disjoint) for r in got] == [("amount", 2, True)]


def test_plan_drift_uses_newest_version(wh):
    drift = reconcile.plan_drift(wh["forecast"], "month", "segment", "amount", wh["plan"], "quarter", "unit", "planned", "version")
    got = {r.quarter: (r.version, r.drift) for r in drift.collect()}
    assert got == {"2026-Q1": (2, round((330 - 345) / 345, 6)), "2026-Q2": (1, 0.0)}


def test_forecast_miss_and_sides(wh, spark):
    forecast = spark.createDataFrame([("q1", D(115)), ("q2", D(10))], "q string, forecast decimal(28,2)")
    actual = spark.createDataFrame([("q1", D(100)), ("q3", D(0))], "q string, actual decimal(28,2)")
    got = {r.q: r.miss for r in reconcile.forecast_vs_actual(forecast, actual, ["q"]).collect()}
    assert got == {"q1": 0.15, "q2": None, "q3": None}
    wide = reconcile.side_by_side({"a": forecast.withColumnRenamed("forecast", "amount"), "b": actual.withColumnRenamed("actual", "amount")}, ["q"])
    assert {r.q: (r.n_systems, r.spread) for r in wide.collect()} == {"q1": (2, D("15.00")), "q2": (1, D("0.00")), "q3": (1, D("0.00"))}


def test_spellings_across_systems(spark):
    crm = spark.createDataFrame([("Acme Corp.",), ("Acme Corp.",), ("Solo Ltd",)], "n string")
    erp = spark.createDataFrame([("ACME CORPORATION",), (None,)], "n string")
    got = quality.spelling_variants([("crm", "n", crm), ("erp", "n", erp)]).collect()
    assert [(r.canonical, r.n_spellings, r.n_rows, r.n_columns) for r in got] == [("ACME", 2, 3, 2)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 30, 500])
def test_quartiles_are_exact(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.gauss(0, 1), 0.5, float(rng.randint(-3, 3))]) for _ in range(n)]
    got = quality.quartiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v")
    pick = lambda p: sorted(values)[math.ceil(p * n) - 1]
    assert (got["q1"], got["q3"]) == (pick(0.25), pick(0.75))


def test_quartiles_of_skewed_values(spark):
    """Half of the rows are one value, the others spread over ten orders of magnitude."""
    rng = random.Random(3)
    values = [7.0] * 20_000 + [10 ** rng.uniform(-5, 5) for _ in range(20_000)]
    got = quality.quartiles(spark.createDataFrame([(v,) for v in values], "v double"), "v")
    values.sort()
    assert got == {"q1": values[9_999], "q3": values[29_999]}


def test_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(100), 1000, -1000]], "v double")
    assert quality.iqr_outliers(df, "v").first().n_outliers == 2
    assert tuple(quality.zscore_outliers(df, "v", 3.0).first()) == (102, 2)
    assert tuple(quality.iqr_outliers(df.limit(0), "v").first()) == (None, None, None, None, 0, 0)


def test_measures(wh):
    won = "stage = 'Closed Won'"
    simple = [measures.simple_measure("total", "sum", "amount", "deals"), measures.simple_measure("accounts", "count_distinct", "account", "deals")]
    mixed = [
        *simple, measures.Measure("won", "sum", "SUM(amount)", ("deals",), won),
        measures.Measure("won_mean", "custom", "SUM(amount) / COUNT(*)", ("deals",), won),
    ]
    row = measures.evaluate(wh["deals"], mixed).first()
    assert (row.total, row.accounts, row.won, float(row.won_mean)) == (D(55000), 4, D(25000), 5000.0)
    by = {r.account: r.won for r in measures.evaluate(wh["deals"], mixed[2:3], ["account"]).collect()}
    assert by == {"Customer 1": D(15000), "Customer 3": D(10000)}
    months = measures.evaluate(wh["invoices"], [measures.simple_measure("n", "count", "*", "invoices")], time=("inv_date", "quarter"))
    assert {str(r.quarter): r.n for r in months.collect()} == {"2026-01-01": 2, "2026-04-01": 1, "2026-07-01": 1}


def test_only_approved_measures_run(wh):
    with pytest.raises(measures.NotApproved, match="total"):
        measures.evaluate(wh["deals"], [measures.simple_measure("total", "sum", "amount", "deals")], approved_only=True)
    with pytest.raises(ValueError):
        measures.simple_measure("m", "median", "amount", "deals")
    with pytest.raises(ValueError):
        measures.Measure("m", "sum", "SUM(x)", ())


def test_variants_disagree(wh):
    annual = wh["deals"].select("opp_id", F.col("arr").cast("double").alias("declared"), F.try_divide(F.col("amount") * 12, "months").cast("double").alias("implied"))
    got = measures.compare_variants(annual, "declared", ["implied"], 1.0)
    assert got.where("implied_disagrees").count() == got.where("declared <> implied").count() == 2
    assert got.where("declared is null or implied is null").where("implied_disagrees is null").count() == 2


def test_measure_filter_reaches_the_scan(spark, tmp_path, capsys):
    spark.range(10).selectExpr("id", "id % 3 as g", "'x' as unused").write.parquet(f"file://{tmp_path}/t")
    measure = measures.Measure("n", "sum", "SUM(id)", ("t",), "g = 1")
    measures.evaluate(spark.read.parquet(f"file://{tmp_path}/t"), [measure]).explain()
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(g), EqualTo(g,1)]" in plan and "ReadSchema: struct<id:bigint,g:bigint>" in plan


def test_registry_resolves_names_when_asked(spark):
    ddl = "id int, name string, status string, approved_at string, aggregation string, sql_expression string, source_tables array<string>, filter_expression string, format_hint string"
    versions = [
        (1, "total", "approved", "2024-01-01", "sum", "SUM(x)", ["t"], None, None), (2, "total", "approved", "2024-02-01", "sum", "SUM(x)", ["t"], "x > 1", None),
        (3, "total", "proposed", None, "sum", "SUM(x) * 100", ["t"], None, None), (4, "draft", "proposed", None, "count", "COUNT(*)", ["t"], None, None),
        (5, "gone", "rejected", None, "count", "COUNT(*)", ["t"], None, None),
    ]
    registry = measures.MeasureRegistry(spark.createDataFrame(versions, ddl))
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, x int")
    assert sorted(map(tuple, registry.evaluate(df, ["total"], ["k"]).collect())) == [("a", 2), ("b", 5)]
    for name in ("draft", "gone", "nothing"):
        with pytest.raises(measures.NotApproved, match=name):
            registry.evaluate(df, ["total", name])


def test_simple_measures_quote_their_columns(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "`order no` int, `net amount` double")
    found = measures.evaluate(df, [measures.simple_measure("net", "sum", "net amount", "t"), measures.simple_measure("orders", "count_distinct", "order no", "t"),
                                   measures.simple_measure("n", "count", "*", "t")]).first()
    assert tuple(found) == (5.0, 1, 2)


def test_only_texts_with_a_bracket_are_parsed(frame, monkeypatch, capsys):
    """Every text that is no JSON would cost an exception."""
    texts = ['{"a": 1}', " \t\r\n[1, 2]", "[", "{", '{"a": }', "[1] x", '{"a": 1} x', '"{}"', "12", "null", "", " ", " {}", "\x0b[]", "﻿{}", "a {}", "{}", "[]", "[{}]", "plain", None]
    df = frame("s string", [(t,) for t in texts])
    always = df.selectExpr("count(s)", "count_if(json_object_keys(s) is not null or json_array_length(s) is not null)").first()
    kept = quality.cut

    def watched(written):
        written.explain()
        return kept(written)

    monkeypatch.setattr(quality, "cut", watched)
    assert tuple(quality.json_share(df, "s").first())[:2] == tuple(always)
    plan = capsys.readouterr().out
    assert 0 < plan.count("jsonObjectKeys(") == plan.count("THEN isnotnull(static_invoke(JsonExpressionUtils.jsonObjectKeys(")
