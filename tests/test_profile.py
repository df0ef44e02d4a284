import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import profile
from assayer.sources import sampling


@pytest.mark.parametrize("values, limit, kept, distinct", [
    (["open", "closed", "open"], 10, ["open", "closed", "open"], 2),
    ([str(i) for i in range(100)], 5, ["0", "1", "2", "3", "4"], 100),
    (["12", None, "24"], 10, ["12", None, "24"], 3),
])
def test_column_samples(frame, values, limit, kept, distinct):
    df = frame("pos int, c string", list(enumerate(values)))
    row = sampling.column_samples(sampling.long_form(df, keep=["pos"]), "pos", limit).first()
    assert (row.sample_values, row.distinct_sample_count) == (kept, distinct)


def test_samples_of_no_rows(frame):
    assert sampling.column_samples(sampling.long_form(frame("pos int, c string", []), keep=["pos"]), "pos").count() == 0


def test_nested_values_are_told_apart_by_json(frame):
    df = frame("pos int, m map<string,int>", [(1, {"a": 1}), (2, {"a": 1}), (3, {"b": 2})])
    row = sampling.column_samples(sampling.long_form(df, keep=["pos"]), "pos").first()
    assert len(row.sample_values) == 3 and row.distinct_sample_count == 2


def test_sample_rows(frame, spark):
    df = spark.range(100)
    assert sampling.sample_rows(df, 7, F.col("id")).collect() == sampling.sample_rows(df, 7, F.col("id")).collect()
    assert sampling.sample_rows(df, 7, seed=1).count() == 7
    with pytest.raises(ValueError):
        sampling.sample_rows(df, 0)
    assert [sampling.has_more_rows(df, n).first()[0] for n in (99, 100, 101)] == [True, False, False]


def make_tables(frame):
    rng = random.Random(3)
    day = datetime.date(2024, 1, 1)
    rows = [
        (i, rng.choice(["a", "b", None]), rng.choice([1.5, -2.0, 10.0]), day.replace(month=rng.randint(1, 12)), "x" * rng.randint(125, 135), rng.random() < 0.5)
        for i in range(60)
    ]
    return {
        "facts": frame("id bigint, code string, amount double, month date, body string, flag boolean", rows),
        "void": frame("id int, name string", []),
        "pairs": frame("a int, b int", [(i % 4, i // 4) for i in range(16)]),
    }


def brute_force(tables):
    out = {}
    for table, df in tables.items():
        rows = df.collect()
        for c in df.columns:
            values = [r[c] for r in rows]
            known = [v for v in values if v is not None]
            key = bool(rows) and len(known) == len(rows) == len(set(known))
            out[table, c] = (len(rows), len(rows) - len(known), len(set(known)), min(known, default=None), max(known, default=None), key)
    return out


@pytest.mark.parametrize("exact", [True, False])
def test_profile_against_brute_force(frame, exact):
    tables = make_tables(frame)
    want = brute_force(tables)
    got = {(r.table_name, r.column_name): r for r in profile.profile(tables, exact).collect()}
    assert set(got) == set(want)
    for place, (n, nulls, distinct, low, high, key) in want.items():
        r = got[place]
        assert (r.n_rows, r.n_nulls, r.n_distinct, r.is_key) == (n, nulls, distinct, key), place
        text = [None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in (low, high)]
        assert [r.min_value, r.max_value] == text, place
        assert r.cardinality == ("very_high" if key else "low" if distinct <= 10 else "medium")


def test_numbers_are_compared_as_numbers(frame):
    row = profile.profile({"t": frame("n bigint", [(9,), (100,), (2**60 + 1,), (2**60,)])}).first()
    assert (row.min_value, row.max_value) == ("9", str(2**60 + 1))


def test_awkward_column_names(frame):
    df = frame("a int", [(1,), (2,)]).toDF("it's a `name`.x\\\\")
    for exact in (True, False):
        row = profile.profile({"odd 'table'": df}, exact).first()
        assert (row.table_name, row.column_name, row.n_distinct) == ("odd 'table'", df.columns[0], 2)


def test_cardinality_edges(spark):
    buckets = spark.createDataFrame([(10,), (11,), (100,), (101,), (10000,), (10001,)], "n bigint").select(
        profile.cardinality(F.col("n"), F.lit(False))
    )
    assert [r[0] for r in buckets.collect()] == ["low", "medium", "medium", "high", "high", "very_high"]


def test_composite_keys(frame):
    tables = make_tables(frame)
    found = profile.composite_keys(tables["pairs"]).collect()
    assert [(r.key_columns, r.n_rows) for r in found] == [(["a", "b"], 16)]
    assert profile.composite_keys(tables["facts"]).count() == 0  # a single key exists
    assert profile.composite_keys(tables["void"]).count() == 0


def test_composite_keys_of_decimals(frame):
    df = frame("a int, b int, c double", [(i, j, 1.0) for i in range(9) for j in range(9)]).selectExpr(
        "cast(a as decimal(10,0)) as a", "cast(b as decimal(10,0)) as b", "c")
    assert [r.key_columns for r in profile.composite_keys(df).collect()] == [["a", "b"]]


@pytest.mark.parametrize("seed", range(6))
def test_composite_keys_equal_brute_force(frame, seed, monkeypatch):
    """Pairs and triples, minimal ones only, columns with NULLs left out; with and without a few rows that refute."""
    monkeypatch.setattr(profile, "REFUTING_ROWS", 5 if seed % 2 else 1000)
    monkeypatch.setattr(profile, "SETS_AT_A_TIME", 3)
    rng = random.Random(seed)
    rows = sorted({(rng.randrange(4), rng.randrange(4), rng.randrange(4), rng.choice("xyz"), rng.choice([0.5, 1.5]), rng.choice([1, 2, None])) for _ in range(40)}, key=str)
    names = "abcdef"
    got = {tuple(r.key_columns) for r in profile.composite_keys(frame("a int, b int, c int, d string, e double, f int", rows)).collect()}
    full = [i for i in range(6) if all(r[i] is not None for r in rows)]
    unique = lambda s: len({tuple(r[i] for i in s) for r in rows}) == len(rows)
    keys = []
    for size in (1, 2, 3):
        keys += [s for s in itertools.combinations(full, size) if unique(s) and not any(set(k) <= set(s) for k in keys)]
    assert got == ({tuple(names[i] for i in k) for k in keys} if not any(len(k) == 1 for k in keys) else set())


@pytest.mark.parametrize("seed", range(4))
def test_key_sets_of_large_tables(frame, seed, monkeypatch):
    """By slices and by parts that seldom repeat, or often; the same sets as when all combinations are grouped."""
    rng = random.Random(seed)
    rows = [(i // 3, rng.randrange(400), rng.randrange(5), rng.choice("xyz"), (i % 3, rng.randrange(3))[seed % 2]) for i in range(300)]
    df = frame("a int, mark int, c int, d string, e int", rows)
    sets = [s for n in (2, 3) for s in itertools.combinations(df.columns, n)]
    want = profile.unique_sets(df, sets)
    grouped, plain = [], profile.unique_sets
    monkeypatch.setattr(profile, "unique_sets", lambda some, s: grouped.append(some.count()) or plain(some, s))
    for name, value in (("WHOLE_ROWS", 10), ("SLICES", 4), ("RARE_ROWS", 12), ("FEW_REPEATED", 100 if seed < 3 else 1)):
        monkeypatch.setattr(profile, name, value)
    repeats = {}
    assert profile.key_sets(df, sets, len(rows), repeats) == want and want
    assert set(repeats) >= set(sets) and not any(repeats[s] for s in want)
    assert seed == 3 or all(n < 200 for n in grouped)


@pytest.mark.parametrize("n", [10, 11, 98, 101, 10_150])
def test_sketched_buckets_are_right_at_their_edges(spark, n):
    df = spark.range(n * 3).selectExpr(f"id % {n} as v")
    row = profile.profile({"t": df}, exact=False).first()
    assert (row.n_distinct, row.cardinality) == (n, "low" if n <= 10 else "medium" if n <= 100 else "high" if n <= 10_000 else "very_high")


def test_top_values_break_ties_by_value(frame):
    df = frame("c string", [("b",), ("a",), ("c",), ("c",), (None,), (None,), (None,)])
    got = profile.top_values({"t": df}, None, 2).orderBy("rank").collect()
    assert [(r.value, r.n, r["rank"]) for r in got] == [("c", 2, 1), ("a", 1, 2)]


def test_top_values_of_long_texts(frame):
    """Texts that begin alike are told apart and ordered by what follows; none is shown as a digest."""
    alike = "same beginning " * 20
    texts = [alike + t for t in ("d", "b", "c", "a", "c")] + ["q" * 192, "short", "z" * 500, "z" * 500, None]
    df = frame("c string, n int", [(t, 1) for t in texts])
    got = profile.top_values({"t": df}, None, 4).where("column_name = 'c'").orderBy("rank").collect()
    assert [(r.value, r.n) for r in got] == [(alike + "c", 2), ("z" * 500, 2), ("q" * 192, 1), (alike + "a", 1)]


def test_top_values_are_dealt_by_cells(frame, spark, monkeypatch):
    """As many tasks sort the values as their cells ask for, whatever the shuffle is made to weigh; the session's settings stay."""
    monkeypatch.setattr(profile, "CELLS_A_TASK", 50)
    seen, kept = [], profile.cut

    def watched(df):
        seen.append((spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")))
        return kept(df)

    monkeypatch.setattr(profile, "cut", watched)
    before = [spark.conf.get(f"spark.sql.{x}") for x in ("shuffle.partitions", "adaptive.coalescePartitions.enabled")]
    got = profile.top_values({"t": frame("a int, b string", [(i % 400, str(i)) for i in range(500)])}, None, 2).orderBy("column_name", "rank").collect()
    assert [(r.column_name, r.value, r.n) for r in got] == [("a", "0", 2), ("a", "1", 2), ("b", "0", 1), ("b", "1", 1)]
    assert seen == [("20", "false")]
    assert [spark.conf.get(f"spark.sql.{x}") for x in ("shuffle.partitions", "adaptive.coalescePartitions.enabled")] == before


def test_grains(frame):
    d = datetime.date
    rows = [(d(2024, 1, 1), d(2024, 1, 1), d(2024, 4, 1), d(2023, 1, 2), d(2024, 1, 5)), (d(2023, 1, 1), d(2024, 2, 1), d(2024, 1, 1), d(2024, 1, 8), None)]
    got = {r.column_name: r.grain for r in profile.time_grains({"t": frame("y date, m date, q date, w date, d date", rows)}).collect()}
    assert got == {"y": "year", "m": "month", "q": "quarter", "w": "week", "d": "day"}


def test_window_limit_runs_before_the_shuffle(frame, capsys):
    profile.top_values({"t": frame("c string", [("a",)])}, None, 3).explain()
    plan = capsys.readouterr().out
    assert plan.index("Partial") > 0 and "WindowGroupLimit" in plan
