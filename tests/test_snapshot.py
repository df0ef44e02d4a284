import pytest
from pyspark.sql import functions as F

from assayer.operators import render, snapshot
from assayer.operators.scope import InvalidScope
from assayer.plans import ingest as plan
from assayer.sources import store
from assayer.sources.inventory import COLUMNS_DDL, column_inventory, primary_keys, row_counts, table_inventory
from assayer.sources.readers import (
    POSTGRES_QUERIES, Source, TableNotFound, TableRef, UnsupportedSource, jdbc_queries, open_source, parquet_source,
)

KEYS_DDL = "database_name string, schema_name string, table_name string, column_name string"


def col(name, ordinal=1, kind="integer", native="integer", nullable=False, table="orders", db="db"):
    return (db, "public", table, name, kind, native, nullable, ordinal, None)


def signed(spark, columns, keys=()):
    keyed = spark.createDataFrame([("db", "public", "orders", k) for k in keys], KEYS_DDL)
    return snapshot.signatures(spark.createDataFrame(columns, COLUMNS_DDL), keyed, [])


def mark(df):
    return snapshot.fingerprints(df, []).first()["fingerprint"]


BASE = [col("id"), col("name", 2)]
CASES = [
    ("same", BASE, ["id"], BASE, ["id"], True),
    ("list order", BASE, [], BASE[::-1], [], True),
    ("key list order", BASE, ["id", "name"], BASE, ["name", "id"], True),
    ("other tables", BASE, [], [col("id", table="users")], [], False),
    ("added column", BASE[:1], [], BASE, [], False),
    ("other type", [col("id")], [], [col("id", kind="numeric", native="numeric")], [], False),
    ("other native type", [col("id")], [], [col("id", native="bigint")], [], False),
    ("nullability", [col("id")], [], [col("id", nullable=True)], [], False),
    ("primary key", BASE, ["id"], BASE, [], False),
    ("ordinals swapped", BASE, [], [col("id", 2), col("name", 1)], [], False),
]


@pytest.mark.parametrize("label, a, a_keys, b, b_keys, equal", CASES, ids=[c[0] for c in CASES])
def test_equivalence(spark, label, a, a_keys, b, b_keys, equal):
    left, right = signed(spark, a, a_keys), signed(spark, b, b_keys)
    assert snapshot.are_equivalent(left, right, "db", "db") is equal
    assert (mark(left) == mark(right)) is equal
    assert snapshot.are_equivalent(left, right, "db", "other") is False


def test_dots_bars_and_nulls_stay_apart(spark):
    def one(db, schema, table, name, native):
        return spark.createDataFrame([(db, schema, table, name, "integer", native, False, 1, None)], COLUMNS_DDL)

    rows = [one("d", "a.b", "c", "x", "int"), one("d", "a", "b.c", "x", "int"), one("d", "a", "b|c", "x", "int"),
            one("d", "a", "b", "c|x", "int"), one("d", "a", "b", "x", None), one("d", None, "b", "x", "int"), one(None, "d", "b", "x", "int")]
    assert len({mark(snapshot.signatures(df, None, [])) for df in rows}) == len(rows)


def test_definitions_of_one_name_get_ids_of_their_own(spark):
    ddl = ("name string, display_name string, description string, rationale string, evidence array<string>, confidence string, "
           "proposed_at timestamp_ntz, prompt_version string, model string, source_snapshot_id string, scope_id string, source_columns array<struct<table:string,column:string>>")
    base = ("n", "N", "d", "r", [], "high", None, "v", None, "s", None)
    rows = [(*base, [("t", "a")]), (*base, [("t", "b")]), (*base, [("t.a", "b")]), (*base, [("t", "a.b")])]
    assert store.definition_rows(spark.createDataFrame(rows, ddl)).select("id").distinct().count() == 4


def test_diff_names_every_change(spark):
    old = [col("id"), col("gone", 2), col("typed", 3), col("loose", 4), col("moved", 5), col("keyed", 6), col("x", table="dropped")]
    new = [col("id"), col("typed", 3, "string", "text"), col("loose", 4, nullable=True), col("moved", 7), col("keyed", 6),
           col("fresh", 8), col("y", table="added"), col("z", 2, table="added")]
    make = lambda rows: spark.createDataFrame(rows, COLUMNS_DDL)
    keys = spark.createDataFrame([("db", "public", "orders", "keyed")], KEYS_DDL)
    got = snapshot.schema_diff(snapshot.sides(snapshot.with_keys(make(old), keys.limit(0), []), snapshot.with_keys(make(new), keys, [])), []).collect()
    assert sorted((r.table_name, r.column_name or "", r.change) for r in got) == [
        ("added", "", "table_added"), ("dropped", "", "table_removed"), ("orders", "fresh", "column_added"),
        ("orders", "gone", "column_removed"), ("orders", "keyed", "key_changed"), ("orders", "loose", "nullability_changed"),
        ("orders", "moved", "moved"), ("orders", "typed", "type_changed"),
    ]


def test_compatibility_takes_the_worst_column(spark):
    links = spark.createDataFrame(
        [("d1", "s", "t", "a", "integer"), ("d1", "s", "t", "b", "string"), ("d2", "s", "t", "a", "integer"), ("d3", "s", "t", "zz", "date"), ("d3", "s", "t", "b", "string")],
        "definition_id string, schema_name string, table_name string, column_name string, normalized_type string",
    )
    now = spark.createDataFrame([("s", "t", "a", "integer"), ("s", "t", "b", "json")], "schema_name string, table_name string, column_name string, normalized_type string")
    got = {r.definition_id: r.compatibility for r in snapshot.compatibility(links, now, []).collect()}
    assert got == {"d1": "needs_review", "d2": "compatible", "d3": "broken"}


@pytest.mark.parametrize("previous, version, skip", [
    (None, "v1", False), (("same", "v1"), "v1", True), (("same", "v1"), "v2", False), (("other", "v1"), "v1", False), (("same", None), "v1", False),
])
def test_skip_matrix(spark, previous, version, skip):
    current = spark.createDataFrame([("db", "same")], "source_database string, fingerprint string")
    rows = [] if previous is None else [("db", "id1", None, *previous)]
    before = spark.createDataFrame(rows, "source_database string, id string, captured_at timestamp_ntz, fingerprint string, prompt_version string")
    row = snapshot.skip_decisions(current, before, version).first()
    assert row.skip is skip and (row.last_snapshot_id == "id1") is skip


def test_latest_breaks_ties_by_id(spark):
    df = spark.createDataFrame([("s", "b", 5), ("s", "a", 5), ("s", "c", 4), ("t", "d", 1)], "source_database string, id string, captured_at int")
    assert {(r.source_database, r.id) for r in snapshot.latest(df).collect()} == {("s", "a"), ("t", "d")}


@pytest.fixture()
def warehouse(spark, tmp_path):
    root = tmp_path / "wh"
    spark.createDataFrame([(1, "open", None), (2, "closed", "2024-01-02")], "id int, status string, closed string").write.parquet(f"file://{root}/sales/orders")
    spark.createDataFrame([(1.5,)], "rate double").write.parquet(f"file://{root}/ref/rates.parquet")
    spark.createDataFrame([(1,)], "x int").write.parquet(f"file://{root}/information_schema/tables")
    return f"file://{root}"


def test_parquet_source_lists_schemas_and_hides_system_ones(spark, warehouse):
    source = open_source(spark, "parquet", warehouse, database="wh")
    assert [t.qualified for t in source.tables] == ["wh.ref.rates", "wh.sales.orders"]
    with pytest.raises(TableNotFound):
        source.read(TableRef("wh", "sales", "nothing"))
    with pytest.raises(UnsupportedSource):
        open_source(spark, "carrier_pigeon", warehouse)
    with pytest.raises(TableNotFound):
        parquet_source(spark, warehouse + "/none")


def test_ingest_round_trip_and_skip(spark, warehouse, tmp_path):
    root = f"file://{tmp_path}/store"
    source = open_source(spark, "parquet", warehouse, database="wh")
    first = plan.ingest(spark, source, root)
    assert (first.skipped, first.n_tables, first.n_columns) == (False, 2, 4)
    again = plan.ingest(spark, source, root)
    assert again.skipped and again.snapshot_id == first.snapshot_id and (again.n_tables, again.n_columns) == (0, 0)
    assert not plan.ingest(spark, source, root, rule_version="rules-v2").skipped

    loaded = {r.table_name: r for r in store.load_snapshots(spark, root, first.snapshot_id).collect()}
    orders = loaded["orders"]
    assert [c.column_name for c in orders["columns"]] == ["id", "status", "closed"]
    assert [c.normalized_type for c in orders["columns"]] == ["integer", "string", "string"]
    assert sorted(orders["columns"][2].sample_values, key=str) == ["2024-01-02", None]
    assert orders["columns"][2].distinct_sample_count == 2
    assert (orders.row_count_estimate, orders.sample_rows_returned, orders.sample_truncated) == (2, 0, False)
    assert store.load_snapshots(spark, root, "no-such-id").count() == 0


def test_scope_limits_the_source(spark, warehouse):
    source = open_source(spark, "parquet", warehouse, database="wh")
    assert [t.name for t in plan.within_scope(spark, source, ["sales"]).tables] == ["orders"]
    assert plan.within_scope(spark, source, ["sales", "ref"], ["sales.orders"]).tables == [TableRef("wh", "ref", "rates")]
    with pytest.raises(InvalidScope):
        plan.within_scope(spark, source, ["Sales"])


def test_catalog_source(spark, tmp_path):
    spark.sql(f"create database shop location 'file://{tmp_path}/shop'")
    spark.sql("create table shop.items (id int comment 'the key', name string) using parquet comment 'things sold'")
    spark.sql("create view shop.names as select name from shop.items")
    spark.sql("insert into shop.items values (1, 'a'), (2, 'b')")
    source = open_source(spark, "catalog", "shop")
    assert [(t.schema, t.name) for t in source.tables] == [("shop", "items")]
    assert list(source.comments.values()) == ["things sold"]
    columns = column_inventory(spark, source).orderBy("ordinal_position").collect()
    assert [(c.column_name, c.normalized_type, c.ordinal_position, c.comment) for c in columns] == [("id", "integer", 1, "the key"), ("name", "string", 2, None)]
    assert row_counts(spark, source).first().row_count == 2
    estimated = row_counts(spark, source, exact=False).first()
    assert estimated.row_count is None and estimated.is_estimate is True


def test_jdbc_catalogue_queries_hide_views_and_system_schemas():
    for query in [*jdbc_queries().values(), *POSTGRES_QUERIES.values()]:
        assert "'pg_catalog', 'information_schema', 'pg_toast'" in query
    assert "BASE TABLE" in jdbc_queries()["tables"] and "PRIMARY KEY" in jdbc_queries()["keys"]
    assert "reltuples < 0 then null" in POSTGRES_QUERIES["statistics"]


def test_primary_keys_and_native_columns_of_a_catalogued_warehouse(spark):
    """What the JDBC reader hands over, given as frames."""
    ref = TableRef("erp", "s", "t")
    native = spark.createDataFrame(
        [("s", "t", "b", "varchar", 1, 2, None), ("s", "t", "a", "int4", 0, 1, "key"), ("s", "a_view", "x", "date", 1, 1, None)],
        "schema_name string, table_name string, column_name string, native_type string, nullable_flag int, ordinal_position int, comment string",
    )
    keys = spark.createDataFrame([("s", "t", "z", 2), ("s", "t", "a", 1)], "schema_name string, table_name string, column_name string, key_position int")
    estimates = spark.createDataFrame([("s", "t", 1000)], "schema_name string, table_name string, row_count_estimate bigint")
    source = Source("jdbc", "erp", [ref], lambda r: spark.range(3), {}, native, keys, estimates)
    got = [(c.column_name, c.normalized_type, c.is_nullable) for c in column_inventory(spark, source).orderBy("ordinal_position").collect()]
    assert got == [("a", "integer", False), ("b", "string", True)]
    assert primary_keys(spark, source).first().primary_key_columns == ["a", "z"]
    assert row_counts(spark, source, exact=False).first().row_count == 1000


def test_no_tables(spark, tmp_path):
    nothing = Source("parquet", "wh", [], lambda ref: None)
    captured = plan.capture(spark, nothing)
    assert captured.source_database == "" and captured.tables.count() == 0 and captured.columns.count() == 0


def test_table_comments_come_from_metadata(spark):
    df = spark.range(1).select(F.col("id").alias("id", metadata={"comment": "the key"}))
    ref = TableRef("wh", "s", "t")
    source = Source("catalog", "wh", [ref], lambda r: df, {ref: "a table"})
    assert table_inventory(spark, source).first().comment == "a table"
    assert column_inventory(spark, source).first().comment == "the key"


def table_row(**changes):
    row = dict(
        database_name="test_db", schema_name="public", table_name="orders", primary_key_columns=["id", "sku"], row_count_estimate=1234,
        comment=None, sample_rows_returned=3, sample_truncated=True,
        columns=[(1, "id", "integer", "bigint", False, ["1", None, "2", "3", "4", "5", "6"], 7), (2, "status", "string", "text", True, ["open"], 1), (3, "e", "date", "date", True, [], 0)],
    )
    return row | changes


RENDER_DDL = (
    "database_name string, schema_name string, table_name string, primary_key_columns array<string>, row_count_estimate bigint, comment string, "
    "sample_rows_returned int, sample_truncated boolean, columns array<struct<ordinal_position:int,column_name:string,normalized_type:string,"
    "native_type:string,is_nullable:boolean,sample_values:array<string>,distinct_sample_count:bigint>>"
)


def markdown(spark, **changes):
    row = table_row(**changes)
    names = [c.split()[0] for c in RENDER_DDL.split(", ")]
    return render.describe_tables(spark.createDataFrame([tuple(row[n] for n in names)], RENDER_DDL)).first().markdown


def test_markdown(spark):
    lines = markdown(spark).split("\n")
    assert lines[0] == "## Table: `test_db.public.orders`"
    assert "- **Primary key:** `id`, `sku`" in lines and "- **Row count (estimate):** ~1,234" in lines
    assert "- **Sample:** 3 rows (truncated, more rows exist)" in lines
    assert lines[-3:] == [
        "| 1 | `id` | `integer` | `bigint` | no | 7 | 1, NULL, 2, 3, 4, …(+2 more) |",
        "| 2 | `status` | `string` | `text` | yes | 1 | 'open' |",
        "| 3 | `e` | `date` | `date` | yes | 0 | _(none)_ |",
    ]


def test_markdown_without_key_count_or_columns(spark):
    out = markdown(spark, primary_key_columns=[], row_count_estimate=None, comment="Deals", sample_truncated=False)
    assert "_(none detected)_" in out and "_unknown (table not yet analyzed)_" in out and "_Table comment: Deals_" in out
    assert "truncated, more" not in out
    assert "No tables found" in render.snapshot_heading("test_db", 0)
