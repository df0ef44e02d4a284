"""Data-quality checks. Each gives rows of one shape:
severity, title, table_name, column_name, evidence, measured, threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions.cells import literal, quoted
from assayer.functions.names import canonical_name
from assayer.session import cut

FLAG = ["severity", "title", "table_name", "column_name", "evidence", "measured", "threshold"]


def flag(severity: str | Column, title: str, table: str | Column, column: str | Column | None, evidence: Column,
         measured: Column, threshold: float | None) -> list[Column]:
    def text(value):
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    return [
        text(severity).alias("severity"), F.lit(title).alias("title"), text(table).alias("table_name"),
        text(column).alias("column_name"), evidence.alias("evidence"), measured.cast("double").alias("measured"),
        F.lit(threshold).cast("double").alias("threshold"),
    ]


def flags_of(df: DataFrame, condition: str, severity: str, title: str, table: str | Column, column: str | Column | None,
             evidence: str, measured: str, threshold: float | None) -> DataFrame:
    """Rows of any check as flags: those that fulfil the condition, with evidence and measured value as SQL."""
    return df.where(condition).select(*flag(severity, title, table, column, F.expr(evidence), F.expr(measured), threshold))


def null_rates(profiles: DataFrame, threshold: float) -> DataFrame:
    rate = F.try_divide(F.col("n_nulls"), F.col("n_rows"))
    evidence = F.concat(F.col("n_nulls").cast("string"), F.lit(" of "), F.col("n_rows").cast("string"), F.lit(" rows are NULL"))
    return profiles.where(rate > threshold).select(
        *flag(F.when(rate > 0.5, "error").otherwise("warning"), "High NULL rate", F.col("table_name"), F.col("column_name"),
              evidence, F.round(rate, 6), threshold)
    )


def spelling_variants(columns: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(canonical, n_spellings, n_columns, n_rows, first_spelling, last_spelling) for names written in several ways.

    `columns` are (table, column, DataFrame); raw spellings are counted before they are canonicalised.
    """
    parts = [
        df.select(F.lit(f"{t}.{c}").alias("place"), F.col(c).alias("raw")).where("raw is not null")
        .groupBy("place", "raw").agg(F.count("*").alias("n"))
        for t, c, df in columns
    ]
    # a name of punctuation alone has no canonical form and is a variant of nothing
    counted = cut(reduce(DataFrame.unionByName, parts).withColumn("canonical", canonical_name(F.col("raw"))).where("canonical is not null"))
    per_spelling = counted.groupBy("canonical", "raw").agg(F.sum("n").alias("n"))
    per_place = counted.groupBy("canonical").agg(F.count_distinct("place").alias("n_columns"))
    return (
        per_spelling.groupBy("canonical").agg(
            F.count("*").alias("n_spellings"), F.sum("n").alias("n_rows"),
            F.min("raw").alias("first_spelling"), F.max("raw").alias("last_spelling"),
        ).where("n_spellings > 1").join(per_place, "canonical")
    )


ABBREVIATION = 3  # letters of an abbreviated code at most


def code_variants(df: DataFrame, column: str) -> DataFrame:
    """(code, n_spellings, n_rows, spellings' first and last) of codes that are written in several ways.

    Values are one code if they differ in case and punctuation only, or if one abbreviates the other: up to three
    letters that exactly one longer value begins with.
    """
    counted = df.select(F.col(column).alias("raw")).where("raw is not null").groupBy("raw").agg(F.count("*").alias("n"))
    # cut, as it is used twice, and as Spark would carry the expression behind the column through all conditions below
    folded = cut(counted).withColumn("folded", F.regexp_replace(F.upper("raw"), r"[^\p{L}\p{N}]", ""))
    longer = folded.where(F.length("folded") > ABBREVIATION).select("folded").distinct().withColumnRenamed("folded", "long")
    beginnings = F.explode(F.transform(F.sequence(F.lit(1), F.lit(ABBREVIATION)), lambda n: F.left("long", n)))
    short = longer.select("long", beginnings.alias("folded")).groupBy("folded").agg(
        F.count("*").alias("n_long"), F.min("long").alias("long")).where("n_long = 1").drop("n_long")
    coded = folded.join(short, "folded", "left").withColumn("code", F.coalesce("long", "folded"))
    return coded.groupBy("code").agg(
        F.count("*").alias("n_spellings"), F.sum("n").alias("n_rows"),
        F.min("raw").alias("first_spelling"), F.max("raw").alias("last_spelling"),
    ).where("n_spellings > 1")


def outside_domain(df: DataFrame, column: str, codes: DataFrame, code: str) -> DataFrame:
    """(value, n_rows) of values that the code table does not know."""
    counted = df.select(F.col(column).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n_rows"))
    return counted.join(codes.select(F.col(code).alias("value")).distinct(), "value", "left_anti")


def formula_violations(df: DataFrame, actual: str, expected: str, tolerance: float = 0.0) -> DataFrame:
    """One row: compared rows, violations, rate, and the median factor actual/expected.

    A factor near a round number (12 for a yearly figure stored per month) points
    at the mistake. The median is a sketch, so its state stays small.
    """
    a, e = F.expr(actual), F.expr(expected)
    broken = F.abs(a - e) > F.lit(tolerance)
    return df.agg(
        F.count(F.when(a.isNotNull() & e.isNotNull(), 1)).alias("n_rows"),
        F.count(F.when(broken, 1)).alias("n_violations"),
        F.round(F.try_divide(F.count(F.when(broken, 1)), F.count(F.when(a.isNotNull() & e.isNotNull(), 1))), 6).alias("violation_rate"),
        F.round(F.approx_percentile(F.try_divide(a, e), 0.5, 10000), 4).alias("median_factor"),
    )


def rule_violations(df: DataFrame, rule: str) -> DataFrame:
    """One row: rows where a boolean rule is known, and where it is false."""
    return df.agg(F.count(F.expr(rule)).alias("n_rows"), F.count(F.when(~F.expr(rule), 1)).alias("n_violations")).withColumn(
        "violation_rate", F.round(F.try_divide(F.col("n_violations"), F.col("n_rows")), 6)
    )


QUARTILES = {"q1": 0.25, "q3": 0.75}
ACCURACY = 10_000  # of the sketches: ranks are off by one in so many rows at most
MARGIN = 0.0005  # of the ranks on either side of a quartile that a bracket takes in


def _number(column: str) -> str:
    """SQL for a column as a double; NaN counts as missing."""
    return f"nullif(cast({quoted(column)} as double), double('NaN'))"


def _each_column(tables: dict[str, DataFrame], entries: list[tuple[str, str]], value: Callable[[str], str],
                 aggregates: Callable[[int], str]) -> DataFrame:
    """id, table_name, column_name and the aggregates of every entry: one aggregate a table, one job for all.

    `value` gives SQL for a column, which the SQL of `aggregates` calls x and the entry's number.
    """
    parts = []
    for table, df in tables.items():
        mine = [(i, c) for i, (t, c) in enumerate(entries) if t == table]
        if mine:
            rows = ", ".join(
                f"struct({i} as id, {literal(table)} as table_name, {literal(c)} as column_name, {aggregates(i)})" for i, c in mine)
            parts.append(df.selectExpr(*[f"{value(c)} as x{i}" for i, c in mine]).selectExpr(f"array({rows}) as every").selectExpr("inline(every)"))
    return reduce(DataFrame.unionByName, parts)


def _sketches(tables: dict[str, DataFrame], entries: list[tuple[str, str]]) -> dict[int, dict]:
    """Of each column (by its place in `entries`): rows with a value, least, most, and the ends of both brackets.

    Table by table, so that the driver holds one plan and its jobs at a time.
    """
    shares = ", ".join(str(p + d) for p in QUARTILES.values() for d in (-MARGIN, MARGIN))
    found = [_each_column({table: tables[table]}, entries, _number, lambda i: (
        f"count(x{i}) as n, min(x{i}) as least, max(x{i}) as most, approx_percentile(x{i}, array({shares}), {ACCURACY}) as cuts"))
        for table in dict.fromkeys(t for t, _ in entries)]
    return {r["id"]: r.asDict() for df in found for r in df.collect()}  # a row per column


def _brackets(sketch: dict, factor: float) -> list[tuple[float, float]]:
    """Disjoint ranges that hold both quartiles and both fences, unless the sketch is further off than it may be."""
    a1, b1, a3, b3 = sketch["cuts"]
    a3, b3 = max(a3, a1), max(b3, b1)
    low = (a1 - factor * (b3 - a1), b1 - factor * max(a3 - b1, 0.0))
    high = (a3 + factor * max(a3 - b1, 0.0), b3 + factor * (b3 - a1))
    out: list[list[float]] = []
    for start, end in sorted([low, (a1, b1), (a3, b3), high]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(r) for r in out]


def _zones(ranges: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """What lies between and beyond the ranges, and they themselves: zone 2 * j is the gap before range j, 2 * j + 1 the range."""
    out, last = [], -math.inf
    for start, end in ranges:
        out += [(last, start), (start, end)]
        last = end
    return [*out, (last, math.inf)]


def _double(x: float) -> str:
    return f"double('{x!r}')" if math.isfinite(x) else f"double('{'-' if x < 0 else ''}Infinity')"


def _histogram(tables: dict[str, DataFrame], entries: list[tuple[str, str]], ranges: dict[int, list]) -> DataFrame:
    """(id, zone, value, n): values inside the ranges counted one by one, the others by zone. One scan a table."""
    parts = []
    for table, df in tables.items():
        mine = [(i, c) for i, (t, c) in enumerate(entries) if t == table and i in ranges]
        if not mine:
            continue
        cells = []
        for i, _ in mine:
            steps = " ".join(
                f"when x{i} < {_double(start)} then {2 * j} when x{i} <= {_double(end)} then {2 * j + 1}"
                for j, (start, end) in enumerate(ranges[i]))
            cells.append(f"struct({i} as id, case when x{i} is null then null {steps} else {2 * len(ranges[i])} end as zone, x{i} as value)")
        parts.append(df.selectExpr(*[f"{_number(c)} as x{i}" for i, c in mine]).selectExpr(f"inline(array({', '.join(cells)}))"))
    placed = reduce(DataFrame.unionByName, parts).where("zone is not null")
    return placed.groupBy("id", "zone", F.when(F.col("zone") % 2 == 1, F.col("value")).alias("value")).agg(F.count("*").alias("n"))


def _running(counts: DataFrame) -> DataFrame:
    """Adds `before`, the rows of the column with smaller values. Summed by ranges first, so that no task orders a whole column."""
    parts = cut(counts.repartitionByRange("id", "zone", "value").withColumn("part", F.spark_partition_id()))
    upto = (Window.unboundedPreceding, -1)
    sums = parts.groupBy("id", "part").agg(F.sum("n").alias("n")).select(
        "id", "part", F.coalesce(F.sum("n").over(Window.partitionBy("id").orderBy("part").rowsBetween(*upto)), F.lit(0)).alias("base"))
    inner = F.sum("n").over(Window.partitionBy("id", "part").orderBy("zone", "value").rowsBetween(*upto))
    return parts.withColumn("inner", F.coalesce(inner, F.lit(0))).join(sums, ["id", "part"]).withColumn(
        "before", F.col("base") + F.col("inner")).drop("base", "inner", "part")


def _quartile_rows(tables: dict[str, DataFrame], entries: list[tuple[str, str]], sketches: dict[int, dict], factor: float,
                   ranges: dict[int, list]) -> tuple[list[tuple], list[int]]:
    """Rows of `outliers` for the columns in `ranges`, and the columns whose ranges missed a quartile."""
    spark = next(iter(tables.values())).sparkSession
    counts = cut(_histogram(tables, entries, ranges))
    wanted = spark.createDataFrame(
        [(i, name, math.ceil(p * sketches[i]["n"])) for i in ranges for name, p in QUARTILES.items()], "id int, name string, position bigint")
    reached = _running(counts).join(F.broadcast(wanted), "id").where("before < position and position <= before + n")
    found: dict[int, dict] = {i: {} for i in ranges}
    for r in reached.select("id", "name", "value").collect():  # two rows per column
        found[r["id"]][r["name"]] = r["value"]
    missed = [i for i, q in found.items() if None in q.values()]
    fences = []
    for i, q in found.items():
        if i not in missed:
            reach = factor * (q["q3"] - q["q1"])
            fences.append((i, q["q1"], q["q3"], q["q1"] - reach, q["q3"] + reach))
    if not fences:
        return [], missed
    zones = [(i, z, start, end) for i in ranges for z, (start, end) in enumerate(_zones(ranges[i]))]
    bounded = counts.join(F.broadcast(spark.createDataFrame(zones, "id int, zone int, start double, end double")), ["id", "zone"])
    fenced = bounded.join(F.broadcast(spark.createDataFrame(fences, "id int, q1 double, q3 double, low_fence double, high_fence double")), "id")
    # both fences lie inside ranges, so a gap is beyond them as a whole or not at all
    beyond = F.coalesce(
        (F.col("value") < F.col("low_fence")) | (F.col("value") > F.col("high_fence")),
        (F.col("end") <= F.col("low_fence")) | (F.col("start") >= F.col("high_fence")))
    summed = fenced.groupBy("id", "q1", "q3", "low_fence", "high_fence").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(beyond, F.col("n"))), F.lit(0)).alias("n_outliers"))
    return [tuple(r) for r in summed.collect()], missed  # a row per column


OUTLIERS = "q1 double, q3 double, low_fence double, high_fence double, n_rows bigint, n_outliers bigint"


def outlier_table(tables: dict[str, DataFrame], columns: dict[str, list[str]], factor: float = 1.5) -> DataFrame:
    """table_name, column_name, q1, q3, low_fence, high_fence, n_rows, n_outliers of every given column, all exact.

    Two scans a table, whatever the number of columns. The first sketches all columns; a quartile lies in a narrow
    bracket and so does each fence. The second counts the values inside brackets one by one and all others by zone,
    which tells quartiles and outliers exactly. A column whose bracket missed is counted again over all its values.
    A quartile is the smallest value with at least that share of rows up to it; NULL and NaN are left out.
    """
    spark = next(iter(tables.values())).sparkSession
    entries = [(t, c) for t, names in columns.items() for c in names]
    sketches = _sketches(tables, entries)
    ranges = {i: _brackets(s, factor) for i, s in sketches.items() if s["n"]}
    rows = [(i, None, None, None, None, 0, 0) for i, s in sketches.items() if not s["n"]]
    while ranges:
        done, missed = _quartile_rows(tables, entries, sketches, factor, ranges)
        rows += done
        # the whole column as one range, which cannot miss
        ranges = {i: [(sketches[i]["least"], sketches[i]["most"])] for i in missed}
    names = [(*entries[i], *rest) for i, *rest in rows]
    return spark.createDataFrame(names, f"table_name string, column_name string, {OUTLIERS}")


def quartiles(df: DataFrame, column: str) -> dict[str, float | None]:
    """Exact q1 and q3: the smallest values with at least that share of rows up to them."""
    row = outlier_table({"t": df}, {"t": [column]}).first()
    return {name: row[name] for name in QUARTILES}


def iqr_outliers(df: DataFrame, column: str, factor: float = 1.5) -> DataFrame:
    """One row: quartiles, fences and the rows outside, all exact."""
    return outlier_table({"t": df}, {"t": [column]}, factor).drop("table_name", "column_name")


def zscore_table(tables: dict[str, DataFrame], columns: dict[str, list[str]], limit: float = 3.0) -> DataFrame:
    """table_name, column_name, n_rows, n_outliers: rows further than `limit` standard deviations from the mean.

    Two scans a table for all its columns: means and deviations, then the counts.
    """
    entries = [(t, c) for t, names in columns.items() for c in names]
    known = [(r["mean"], r["sd"]) for r in _each_column(
        tables, entries, _number, lambda i: f"avg(x{i}) as mean, stddev(x{i}) as sd").orderBy("id").collect()]  # a row per column

    def counted(i: int) -> str:
        mean, sd = known[i]
        far = f"abs(x{i} - {_double(mean)}) > {_double(limit * sd)}" if sd is not None else "false"
        return f"count(x{i}) as n_rows, count_if({far}) as n_outliers"

    return _each_column(tables, entries, _number, counted).drop("id")


def zscore_outliers(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """One row: rows, and rows further than `limit` standard deviations from the mean."""
    return zscore_table({"t": df}, {"t": [column]}, limit).drop("table_name", "column_name")


def empty_tables(counts: DataFrame) -> DataFrame:
    return counts.where("row_count = 0").select(
        *flag("info", "Empty table", F.col("table_name"), None, F.lit("no rows"), F.lit(0), 0.0)
    )


def staleness(df: DataFrame, table: str, column: str, as_of: str) -> DataFrame:
    """One row: newest and oldest day, days behind the given day, number of years, and frozen or not."""
    day = F.col(column).cast("date")
    return df.agg(
        F.min(day).alias("oldest"), F.max(day).alias("newest"), F.count_distinct(F.year(day)).alias("n_years")
    ).select(
        F.lit(table).alias("table_name"), F.lit(column).alias("column_name"),
        F.col("oldest").cast("string").alias("oldest"), F.col("newest").cast("string").alias("newest"), "n_years",
        F.date_diff(F.lit(as_of).cast("date"), F.col("newest")).alias("days_behind"),
        (F.col("newest") < F.lit(as_of).cast("date")).alias("before_cutoff"),
        (F.col("n_years") == 1).alias("single_year"),
    )


def nonzero_rate(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count(c).alias("n_rows"), F.count(F.when(c != 0, 1)).alias("n_nonzero")).withColumn(
        "nonzero_rate", F.round(F.try_divide(F.col("n_nonzero"), F.col("n_rows")), 6)
    )


def name_collisions(profiles: DataFrame, base_name: Column) -> DataFrame:
    """(base_name, n_tables, n_types, disjoint): one name in several tables with other types or ranges that never meet."""
    number = F.expr("try_cast(min_value as double)"), F.expr("try_cast(max_value as double)")
    named = profiles.select(base_name.alias("base_name"), "table_name", "normalized_type", number[0].alias("low"), number[1].alias("high"))
    grouped = named.groupBy("base_name").agg(
        F.count_distinct("table_name").alias("n_tables"),
        F.count_distinct("normalized_type").alias("n_types"),
        F.coalesce(F.max("low") > F.min("high"), F.lit(False)).alias("disjoint"),
    )
    return grouped.where("n_tables > 1 and (n_types > 1 or disjoint)")


def json_shares(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """table_name, column_name, n_rows, n_json, json_share: how many non-null strings hold a JSON object or array. One scan a table."""
    entries = [(t, c) for t, names in columns.items() for c in names]
    # A JSON object or array begins with its bracket. Other texts are not parsed, as every failure costs an exception.
    held = ("case left(trim(leading ' \t\n\r\ufeff' from x{0}), 1) when '{{' then json_object_keys(x{0}) is not null "
            "when '[' then json_array_length(x{0}) is not null else false end")
    # written table by table, so that the driver holds one plan and its jobs at a time
    counted = reduce(DataFrame.unionByName, [cut(_each_column({table: tables[table]}, entries, lambda c: f"cast({quoted(c)} as string)", lambda i: (
        f"count(x{i}) as n_rows, count_if({held.format(i)}) as n_json"))) for table in dict.fromkeys(t for t, _ in entries)])
    return counted.drop("id").withColumn("json_share", F.round(F.try_divide(F.col("n_json"), F.col("n_rows")), 6))


def json_share(df: DataFrame, column: str) -> DataFrame:
    """One row: how many non-null strings hold a JSON object or array."""
    return json_shares({"t": df}, {"t": [column]}).drop("table_name", "column_name")
