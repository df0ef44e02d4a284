from pyspark.sql import functions as F, types as T

from assayer.functions import names, text
from assayer.functions.types import normalize_native, normalize_spark

NATIVE = {
    "character varying": "string", "varchar(50)": "string", "text": "string", "uuid": "string", "smallint": "integer",
    "integer": "integer", "bigint": "integer", "serial": "integer", "numeric": "numeric", "numeric(12,2)": "numeric",
    "decimal": "numeric", "real": "numeric", "double precision": "numeric", "money": "numeric", "boolean": "boolean",
    "bool": "boolean", "date": "date", "timestamp": "timestamp", "timestamp without time zone": "timestamp",
    "timestamp with time zone": "timestamp", "json": "json", "jsonb": "json", "STRING": "string", "INT64": "integer",
    "FLOAT64": "numeric", "DATETIME": "timestamp", "VARCHAR2(255)": "string", "NUMBER": "unknown", "geometry": "unknown",
    "hstore": "unknown", "": "unknown", "INTEGER": "integer", "Varchar": "string", "BoOlEaN": "boolean",
    "  integer  ": "integer", "int4range": "integer", "daterange": "date", "interval": "unknown", "bytea": "unknown",
}


def test_native_types(frame):
    df = frame("t string", [(t,) for t in NATIVE])
    got = {r.t: r.n for r in df.select("t", normalize_native(F.col("t")).alias("n")).collect()}
    assert got == NATIVE


def test_spark_types_go_by_structure():
    cases = {
        T.ByteType(): "integer", T.IntegerType(): "integer", T.LongType(): "integer", T.FloatType(): "numeric",
        T.DecimalType(12, 2): "numeric", T.BooleanType(): "boolean", T.DateType(): "date", T.TimestampType(): "timestamp",
        T.TimestampNTZType(): "timestamp", T.StringType(): "string", T.ArrayType(T.FloatType()): "json",
        T.MapType(T.StringType(), T.LongType()): "json", T.StructType([T.StructField("a", T.DateType())]): "json",
        T.BinaryType(): "unknown", T.NullType(): "unknown",
    }
    assert {k.simpleString(): normalize_spark(k) for k in cases} == {k.simpleString(): v for k, v in cases.items()}


def test_split_qualified(frame):
    df = frame("n string", [("db.s.t",), ("s.t",), ("t",), ("a.b.c.d",), (None,)])
    schema, table = names.split_qualified(F.col("n"))
    assert [tuple(r) for r in df.select(schema, table).collect()] == [
        ("s", "t"), ("s", "t"), (None, None), (None, None), (None, None)
    ]


def spellings(base: str, noun: str, short: str) -> list[str]:
    full = f"{base} {noun}"
    return [full, f"{base} {short}".upper(), f"{full}, Inc.", f"{full} Holdings Ltd", base.lower(), f"{base} Co"]


COMPANIES = {base: spellings(base, noun, short) for base, noun, short in [
    ("Northwind", "Industries", "Ind."), ("Fabrikam", "Enterprises", "Ent"), ("Contoso", "Systems", "Sys"),
    ("Tailspin", "Imports", "Import"), ("Blue Yonder", "Group", "Grp."), ("Wingtip", "Corporation", "Corp"),
]}


def test_spellings_of_one_company_share_key_and_canonical_form(frame):
    df = frame("base string, raw string", [(b, s) for b, all_of in COMPANIES.items() for s in all_of])
    per_base = df.groupBy("base").agg(
        F.count_distinct(names.block_key(F.col("raw"))).alias("keys"),
        F.count_distinct(names.canonical_name(F.col("raw"))).alias("canonical"),
    ).collect()
    assert {(r["keys"], r["canonical"]) for r in per_base} == {(1, 1)}
    assert df.select(names.canonical_name(F.col("raw"))).distinct().count() == len(COMPANIES)


def test_a_name_made_of_designators_keeps_its_first_word(frame):
    got = frame("n string", [("Group Inc",), ("Systems",), ("IT",)]).select(names.canonical_name(F.col("n"))).collect()
    assert [r[0] for r in got] == ["GROUP", "SYSTEMS", "IT"]


def test_machine_names(frame):
    df = frame("n string", [("arr_sales",), ("Arr",), ("1st",), ("naïve",), ("total_2",), ("",)])
    assert [r[0] for r in df.select(names.is_machine_name(F.col("n"))).collect()] == [True, False, False, False, True, False]
    assert df.where(names.ends_in_number(F.col("n"))).collect()[0].n == "total_2"


def test_json_body(frame):
    cases = {
        '  {"a": 1}\n': '{"a": 1}', '```json\n{"a": 1}\n```': '{"a": 1}', 'Sure: {"a": {"b": 2}} bye': '{"a": {"b": 2}}',
        "not json at all ": "not json at all", "} {": "} {", "": "",
    }
    df = frame("t string", [(t,) for t in cases])
    assert {r.t: r.b for r in df.select("t", text.json_body(F.col("t")).alias("b")).collect()} == cases


def test_display(frame):
    rows = [("open", "'open'"), ("it's", '"it\'s"'), ("a\nb", "'a\\nb'"), (None, "NULL"), ("x" * 80, "'" + "x" * 56 + "…'"), ("x" * 58, "'" + "x" * 58 + "'")]
    df = frame("v string, want string", rows)
    assert df.where(text.display_value(F.col("v")) != F.col("want")).count() == 0
    lists = frame("v array<string>", [([str(i) for i in range(10)],), (["a"],), ([],), (None,)])
    assert [r[0] for r in lists.select(text.display_samples(F.col("v"))).collect()] == [
        "0, 1, 2, 3, 4, …(+5 more)", "a", "_(none)_", "_(none)_"
    ]


def test_deletion_keys_are_all_strings_within_reach(frame):
    got = frame("n string", [("abc",)]).select(names.deletion_keys(F.col("n"), 2)).first()[0]
    assert sorted(got) == sorted(["abc", "bc", "ac", "ab", "a", "b", "c"])
    assert frame("n string", [("",)]).select(names.deletion_keys(F.col("n"), 2)).first()[0] == [""]
