"""Column profiles over whole tables."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from assayer.functions.cells import comparable_text, literal, quoted
from assayer.functions.types import normalize_spark
from assayer.session import cut, settings
from assayer.vocab import CARDINALITY_LIMITS

# Values longer than this are grouped by a SHA-256 of the whole value, so that
# counting distinct documents does not shuffle the documents.
DIGEST_ABOVE = 128

# Declared relative error of a distinct-count sketch, and the band of six such errors that is not trusted.
SKETCH_ERROR = 0.05
SKETCH_BAND = 6 * SKETCH_ERROR

# Types grouped as they are; every other type is grouped by its text.
FAMILIES = ["bigint", "double", "date", "timestamp", "timestamp_ntz", "string"]


def _name(column: str) -> Column:
    return F.col(quoted(column))


def _family(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return "bigint"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double"
    for kind, name in [(T.DateType, "date"), (T.TimestampType, "timestamp"), (T.TimestampNTZType, "timestamp_ntz")]:
        if isinstance(data_type, kind):
            return name
    return "string"


def short_form(value: str, digest: bool | str) -> str:
    """SQL for what stands for a long text; with its beginning it is longer than any text that stands for itself."""
    return f"concat(left({value}, {DIGEST_ABOVE}), sha2({value}, 256))" if digest == "beginning" else f"sha2({value}, 256)"


class Columns:
    """The columns of several tables, numbered. Cells carry the number instead of three names."""

    def __init__(self, tables: dict[str, DataFrame], chosen: dict[str, list[str]] | None = None):
        self.tables = tables
        # columns of one table and family have consecutive numbers
        self.entries = [
            (table, f.name, f.dataType, position)
            for table, df in tables.items()
            for family in FAMILIES
            for position, f in enumerate(df.schema.fields, start=1)
            if _family(f.dataType) == family and (chosen is None or f.name in chosen.get(table, []))
        ]

    def listing(self) -> str:
        """SQL array of (table_name, column_name, normalized_type, ordinal_position)."""
        return "array({})".format(", ".join(
            f"named_struct('table_name', {literal(t)}, 'column_name', {literal(c)}, 'normalized_type', '{normalize_spark(k)}', 'ordinal_position', {p})"
            for t, c, k, p in self.entries
        ))

    def named(self, df: DataFrame, *others: str) -> DataFrame:
        """Replaces `column_id` by the names it stands for."""
        looked_up = df.withColumn("place", F.expr(f"element_at({self.listing()}, column_id + 1)"))
        return looked_up.select("place.table_name", "place.column_name", "place.normalized_type", "place.ordinal_position", *others)

    def cells(self, family: str, digest: bool | str = True) -> DataFrame | None:
        """(column_id, value) of all columns of one family. Each column of each table is read by one family only.

        Long texts are digests, or with `digest="beginning"` their beginning and digest, or whole.
        """
        parts = []
        for table, df in self.tables.items():
            numbers = [n for n, (t, _, kind, _) in enumerate(self.entries) if t == table and _family(kind) == family]
            if not numbers:
                continue
            values = []
            for _, c, kind, _ in self.entries[numbers[0]:numbers[-1] + 1]:
                value = f"cast({quoted(c)} as {family})" if family != "string" else comparable_text(c, kind)
                if family == "string" and digest:
                    value = f"if(length({value}) > {DIGEST_ABOVE}, {short_form(value, digest)}, {value})"
                values.append(value)
            spread = df.selectExpr(f"posexplode(array({', '.join(values)})) as (place, value)")
            parts.append(spread.selectExpr(f"place + {numbers[0]} as column_id", "value"))
        return reduce(DataFrame.union, parts) if parts else None

    def long_texts(self) -> DataFrame | None:
        """(column_id, value, text): long texts next to their beginning and digest, one scan a table."""
        parts = []
        for table, df in self.tables.items():
            numbered = [(n, comparable_text(c, k)) for n, (t, c, k, _) in enumerate(self.entries) if t == table and _family(k) == "string"]
            if numbered:
                cells = ", ".join(f"if(length({v}) > {DIGEST_ABOVE}, struct({n} as column_id, {v} as text), null)" for n, v in numbered)
                parts.append(df.selectExpr(f"inline(array_compact(array({cells})))"))
        return reduce(DataFrame.union, parts).selectExpr(
            "column_id", f"{short_form('text', 'beginning')} as value", "text") if parts else None

    def counts(self, family: str, digest: bool | str = True) -> DataFrame | None:
        """(column_id, value, n), NULL being a value. Counted before the shuffle, so a value that
        holds most rows arrives as one row per task."""
        cells = self.cells(family, digest)
        return None if cells is None else cells.groupBy("column_id", "value").agg(F.count("*").alias("n"))

    def text_bounds(self) -> list[DataFrame]:
        """(column_id, low, high) of text columns: one pass per table over these columns, nothing grouped."""
        parts = []
        for table, df in self.tables.items():
            numbered = [
                (number, c) for number, (t, c, kind, _) in enumerate(self.entries)
                if t == table and _family(kind) == "string" and normalize_spark(kind) not in ("json", "unknown")
            ]
            if numbered:
                bounds = df.selectExpr(*[f"min({quoted(c)}) as l{n}" for n, c in numbered], *[f"max({quoted(c)}) as h{n}" for n, c in numbered])
                rows = ", ".join(f"struct({n} as column_id, cast(l{n} as string) as low, cast(h{n} as string) as high)" for n, _ in numbered)
                parts.append(bounds.selectExpr(f"inline(array({rows}))"))
        return parts


def value_counts(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None, digest: bool = True,
                 nulls: bool = False) -> DataFrame:
    """(table_name, column_name, normalized_type, value, n), values as text, long ones by digest; NULLs on request."""
    chosen = Columns(tables, columns)
    counted = [chosen.counts(f, digest) for f in FAMILIES]
    texts = [
        (c if nulls else c.where("value is not null")).select("column_id", F.col("value").cast("string").alias("value"), "n")
        for c in counted if c is not None
    ]
    return chosen.named(reduce(DataFrame.unionByName, texts), "value", "n").drop("ordinal_position")


def _per_column(counts: DataFrame, family: str) -> DataFrame:
    low, high = (F.lit(None), F.lit(None)) if family == "string" else (F.min("value"), F.max("value"))
    return counts.groupBy("column_id").agg(
        F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_nulls"),
        low.cast("string").alias("low"), high.cast("string").alias("high"),
    )


def _sketched(columns: Columns) -> list[DataFrame]:
    """The same figures with distinct counts from sketches: one pass per table, no values shuffled."""
    parts = []
    for table, df in columns.tables.items():
        numbered = [(n, c, k) for n, (t, c, k, _) in enumerate(columns.entries) if t == table]
        plain = [n for n, _, k in numbered if normalize_spark(k) not in ("json", "unknown")]
        aggregates = ["count(*) as n_rows"]
        for n, c, k in numbered:
            aggregates += [f"count({quoted(c)}) as c{n}", f"approx_count_distinct({comparable_text(c, k)}, {SKETCH_ERROR}) as d{n}"]
            aggregates += [f"min({quoted(c)}) as l{n}", f"max({quoted(c)}) as h{n}"] if n in plain else []
        rows = ", ".join(
            f"struct({n} as column_id, n_rows, d{n} as n_distinct, n_rows - c{n} as n_nulls, "
            + (f"cast(l{n} as string) as low, cast(h{n} as string) as high)" if n in plain else "cast(null as string) as low, cast(null as string) as high)")
            for n, _, _ in numbered
        )
        parts.append(df.selectExpr(*aggregates).selectExpr(f"inline(array({rows}))"))
    return parts


def cardinality(n_distinct: Column, is_key: Column) -> Column:
    bucket = F.when(is_key, "very_high")
    for name, limit in CARDINALITY_LIMITS:
        bucket = bucket.when(n_distinct <= limit, name)
    return bucket.otherwise("very_high")


def profile(tables: dict[str, DataFrame], exact: bool = True) -> DataFrame:
    """The full profile, one row per column of every table.

    Values are grouped in their own type and turned into text last. With `exact=False` distinct counts are sketches,
    except where a sketch's error band touches the row count or the limit of a cardinality bucket, and so decides on
    a key or a bucket: those columns are counted exactly.
    """
    columns = Columns(tables)
    spark = next(iter(tables.values())).sparkSession
    if exact:
        counted = [(f, columns.counts(f)) for f in FAMILIES]
        parts = [_per_column(c, f) for f, c in counted if c is not None] + columns.text_bounds()
    else:
        parts = _sketched(columns)
        sketches = columns.named(reduce(DataFrame.unionByName, parts), "n_rows", "n_distinct")
        near: dict[str, list[str]] = {}
        edges = [F.col("n_rows"), *[F.lit(limit) for _, limit in CARDINALITY_LIMITS]]
        decides = reduce(Column.__or__, [F.col("n_distinct").between(e * (1 - SKETCH_BAND) - 1, e * (1 + SKETCH_BAND) + 1) for e in edges])
        for row in sketches.where((F.col("n_rows") > 0) & decides).collect():  # column names only
            near.setdefault(row.table_name, []).append(row.column_name)
        if near:
            numbers = {(t, c): n for n, (t, c, _, _) in enumerate(columns.entries)}
            decisive = Columns(tables, near)
            back = "array({})".format(", ".join(str(numbers[t, c]) for t, c, _, _ in decisive.entries))
            sure = [
                c.groupBy("column_id").agg(F.count("value").alias("n_exact"))
                for c in (decisive.counts(f) for f in FAMILIES) if c is not None
            ]
            parts += [df.withColumn("column_id", F.expr(f"element_at({back}, column_id + 1)")) for df in sure]
    listed = spark.sql(f"select posexplode({columns.listing()}) as (column_id, place)").select("column_id")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [listed, *parts])
    n_exact = F.max("n_exact") if "n_exact" in stacked.columns else F.lit(None)
    merged = stacked.groupBy("column_id").agg(
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.max("n_nulls"), F.lit(0)).alias("n_nulls"),
        F.coalesce(n_exact, F.max("n_distinct"), F.lit(0)).alias("n_distinct"),
        F.max("low").alias("min_value"), F.max("high").alias("max_value"),
    )
    n_rows, n_nulls, n_distinct = F.col("n_rows"), F.col("n_nulls"), F.col("n_distinct")
    is_key = (n_rows > 0) & (n_nulls == 0) & (n_distinct == n_rows)
    return columns.named(
        merged, n_rows, n_nulls, F.round(F.try_divide(n_nulls, n_rows), 6).alias("null_rate"), n_distinct,
        "min_value", "max_value", is_key.alias("is_key"), cardinality(n_distinct, is_key).alias("cardinality"),
    )


def value_profile(values: DataFrame) -> DataFrame:
    """The part of a profile that value counts (with NULLs) tell by themselves; bounds for integers only."""
    number = F.when(F.col("normalized_type") == "integer", F.col("value").try_cast("decimal(20,0)"))
    counted = values.groupBy("table_name", "column_name", "normalized_type").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_nulls"),
        F.count("value").alias("n_distinct"), F.min(number).alias("low"), F.max(number).alias("high"),
    )
    is_key = (F.col("n_nulls") == 0) & (F.col("n_distinct") == F.col("n_rows"))
    return counted.select(
        "table_name", "column_name", "normalized_type", "n_rows", "n_nulls", "n_distinct",
        F.col("low").cast("string").alias("min_value"), F.col("high").cast("string").alias("max_value"),
        is_key.alias("is_key"), cardinality(F.col("n_distinct"), is_key).alias("cardinality"),
    )


CELLS_A_TASK = 4_000_000  # cells whose distinct values one task sorts


def cell_tasks(columns: Columns) -> int:
    """How many tasks the values of these columns are dealt to; their number grows with the cells."""
    counts = [
        df.agg((F.count("*") * sum(t == table for t, *_ in columns.entries)).alias("n"))
        for table, df in columns.tables.items() if any(t == table for t, *_ in columns.entries)]
    cells = reduce(DataFrame.union, counts).agg(F.sum("n")).first()[0] if counts else 0
    return math.ceil(cells / CELLS_A_TASK)


def top_values(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None, k: int) -> DataFrame:
    """The k most frequent non-null values of each column, ties by value.

    Spark keeps only k rows per column and task before the shuffle, so columns with billions of values do not meet in
    one task. What a task sorts for that is bounded: the values are dealt to as many tasks as their cells ask for, and
    are not put together by their size in the shuffle, which for whole numbers is a small part of their size in memory. Long values are counted by their beginning and digest; the values that may be among the k, which are more
    than k only where they begin alike, are then fetched and ordered in full.
    """
    chosen = Columns(tables, columns)
    counted = [chosen.counts(f, digest="beginning") for f in FAMILIES]
    counts = reduce(DataFrame.unionByName, [
        c.where("value is not null").select("column_id", F.col("value").cast("string").alias("value"), "n") for c in counted if c is not None])
    beginning = F.left("value", F.lit(DIGEST_ABOVE))
    first = Window.partitionBy("column_id").orderBy(F.desc("n"), beginning)
    spark = counts.sparkSession
    tasks = cell_tasks(chosen)
    dealt = {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with settings(spark, dealt if tasks > 1 else {}):
        likely = cut(counts.withColumn("place", F.rank().over(first)).where(F.col("place") <= k).drop("place"))  # about k rows a column
    is_long = F.length("value") > DIGEST_ABOVE
    texts = chosen.long_texts()
    fetched = likely.where(~is_long)
    if texts is not None:
        whole = texts.join(likely.where(is_long), ["column_id", "value"]).groupBy("column_id", "value").agg(
            F.first("text").alias("text"), F.first("n").alias("n"))
        fetched = fetched.unionByName(whole.select("column_id", F.col("text").alias("value"), "n"))
    order = Window.partitionBy("column_id").orderBy(F.desc("n"), "value")
    ranked = fetched.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return chosen.named(ranked, "value", "n", "rank").drop("normalized_type", "ordinal_position")


SETS_AT_A_TIME = 64  # column sets sketched in one aggregate
SETS_A_PLAN = 16  # column sets grouped in one plan, all of which the driver holds
REFUTING_ROWS = 20_000  # rows among which a repeated combination refutes a column set, read from the start of the table


def composite_keys(df: DataFrame, columns: list[str] | None = None, size: int = 3) -> DataFrame:
    """(key_columns, n_rows): the smallest sets of 2 to `size` columns that identify a row where no single column does.

    Level by level: a set is looked at only if none of its subsets is a key, and no key has columns with NULLs. A set
    cannot be a key if the product of its columns' distinct counts, the sketches' error added, is below the row count,
    nor if a few rows hold one of its combinations twice. What is left is sketched, SETS_AT_A_TIME in one scan, and the
    sets within the band of the row count are decided exactly (`key_sets`). Maps and variants are no key columns.
    """
    spark = df.sparkSession
    kept_out = (T.MapType, T.VariantType)
    names = columns or [f.name for f in df.schema.fields if not isinstance(f.dataType, kept_out)]
    empty = spark.createDataFrame([], "key_columns array<string>, n_rows bigint")
    if not names:
        return empty
    single = df.agg(
        F.count("*").alias("n_rows"),
        *[F.count(_name(c)).alias(f"c{i}") for i, c in enumerate(names)],
        *[F.approx_count_distinct(_name(c), SKETCH_ERROR).alias(f"s{i}") for i, c in enumerate(names)],
    ).first()
    n_rows = single["n_rows"]
    most = {c: single[f"s{i}"] * (1 + SKETCH_BAND) + 1 for i, c in enumerate(names) if single[f"c{i}"] == n_rows}
    likely_keys = [(c,) for c, n in most.items() if n >= n_rows]
    repeats: dict[tuple[str, ...], int] = {}
    if n_rows == 0 or key_sets(df, likely_keys, n_rows, repeats):
        return empty
    few = cut(df.select(*[_name(c) for c in most]).limit(REFUTING_ROWS)) if most else None
    keys: list[tuple[str, ...]] = []
    for level in range(2, size + 1):
        sets = [s for s in combinations(most, level)
                if math.prod(most[c] for c in s) >= n_rows and not any(set(k) <= set(s) for k in keys)]
        sets = unique_sets(few, sets)  # repeated among a few rows, so repeated in the table
        near = []
        for at in range(0, len(sets), SETS_AT_A_TIME):
            some = sets[at : at + SETS_AT_A_TIME]
            sketched = df.agg(*[F.approx_count_distinct(F.struct(*map(_name, s)), SKETCH_ERROR).alias(f"p{i}") for i, s in enumerate(some)]).first()
            near += [s for i, s in enumerate(some) if sketched[f"p{i}"] * (1 + SKETCH_BAND) + 1 >= n_rows]
        keys += key_sets(df, near, n_rows, repeats)
    return spark.createDataFrame([(list(k), n_rows) for k in keys], "key_columns array<string>, n_rows bigint") if keys else empty


WHOLE_ROWS = 100_000  # rows up to which all combinations of all sets are grouped at once
SLICES = 256  # of larger tables, the combinations of one slice in so many are grouped first
RARE_ROWS = 200  # a set with so few rows in a slice that share a combination may stand for the sets that hold it
FEW_REPEATED = 100_000  # combinations of such a set that are sent to all tasks


def key_sets(df: DataFrame, sets: list[tuple[str, ...]], n_rows: int, repeats: dict[tuple[str, ...], int]) -> list[tuple[str, ...]]:
    """The column sets of which no combination occurs twice, exactly, without a shuffle of the whole table for each.

    First, the combinations that fall in one slice by their hash refute the sets that repeat any of them. Rows that agree in
    a set agree in each part of it. So of the sets that are left, those with a part in common that seldom repeats are
    decided together: its hashes are grouped over the whole table, and only rows that share one are looked at in full.
    `repeats` keeps what slices showed.
    """
    if n_rows <= WHOLE_ROWS:
        return unique_sets(df, sets)
    repeats |= slice_repeats(df, [s for s in sets if s not in repeats])
    left = [s for s in sets if not repeats[s]]
    parts = list(dict.fromkeys(p for s in left if len(s) > 2 for p in combinations(s, 2)))
    repeats |= slice_repeats(df, [p for p in parts if p not in repeats])
    unique = set()
    while left:
        rare = [p for p in parts if repeats[p] <= RARE_ROWS] + left
        held = {p: [s for s in left if set(p) <= set(s)] for p in rare}
        part = max(rare, key=lambda p: (len(held[p]), -repeats[p]))
        unique.update(_unique_beside(df, part, held[part]))
        left = [s for s in left if s not in held[part]]
    return [s for s in sets if s in unique]


def slice_repeats(df: DataFrame, sets: list[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """For each column set the rows of one slice that share their combination with another row."""
    in_slice = [
        df.where(F.pmod(F.xxhash64(*map(_name, s)), F.lit(SLICES)) == 0).groupBy(*map(_name, s)).agg(F.count("*").alias("n")).where("n > 1")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(i).alias("i"), "n") for i, s in enumerate(sets)]
    return {sets[r["i"]]: r["n"] for at in range(0, len(sets), SETS_A_PLAN) for r in reduce(DataFrame.union, in_slice[at : at + SETS_A_PLAN]).collect()}


def _unique_beside(df: DataFrame, part: tuple[str, ...], sets: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Those of the sets, which all hold `part`, that never repeat."""
    mark = "mark"
    while mark in map(str.lower, df.columns):
        mark += "_"
    marked = F.xxhash64(*map(_name, part)).alias(mark)
    repeated = cut(df.select(marked).groupBy(mark).agg(F.count("*").alias("n")).where("n > 1").select(mark))
    n = repeated.count()
    if not n:
        return sets
    if n > FEW_REPEATED:
        return [s for s in sets if unique_sets(df, [s])]
    columns = dict.fromkeys(c for s in sets for c in s)
    return unique_sets(cut(df.select(*map(_name, columns), marked).join(F.broadcast(repeated), mark, "left_semi").drop(mark)), sets)


def unique_sets(df: DataFrame, sets: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The column sets of which no combination occurs twice, exactly; one job for all."""
    if not sets:
        return []
    repeated = [
        df.groupBy(*map(_name, s)).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(i).alias("i")).limit(1) for i, s in enumerate(sets)]
    refuted = {r["i"] for at in range(0, len(sets), SETS_AT_A_TIME) for r in reduce(DataFrame.union, repeated[at : at + SETS_AT_A_TIME]).collect()}
    return [s for i, s in enumerate(sets) if i not in refuted]


def time_grains(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, grain): the coarsest period whose first instant every value is.

    Finer than a day counts as day.
    """
    parts = []
    for name, df in tables.items():
        columns = [f.name for f in df.schema.fields if normalize_spark(f.dataType) in ("date", "timestamp")]
        if not columns:
            continue
        order = ["year", "quarter", "month", "week"]
        checks = [
            F.bool_and(_name(c).cast("timestamp_ntz") == F.date_trunc(g, _name(c)).cast("timestamp_ntz")).alias(f"{g}_{i}")
            for i, c in enumerate(columns)
            for g in order
        ]
        rows = []
        for i, c in enumerate(columns):
            grain = F.when(F.col(f"year_{i}"), "year")
            for g in order[1:]:
                grain = grain.when(F.col(f"{g}_{i}"), g)
            rows.append(F.struct(F.lit(c).alias("column_name"), grain.otherwise("day").alias("grain")))
        parts.append(df.agg(*checks).select(F.lit(name).alias("table_name"), F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)

