"""Relationships between columns, found from whole columns of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions.names import block_key, canonical_name, deletion_keys
from assayer.session import cut


def inclusions(values: DataFrame, profiles: DataFrame, minimum: float = 1.0) -> DataFrame:
    """Inclusion dependencies: the share of distinct values of one column found in a key column.

    values:   table_name, column_name, normalized_type, value, n   (distinct non-null values)
    profiles: the column profile

    Pairs are pruned on the profiles alone: same type, the target a key with enough distinct values and, for integers,
    a range that allows the inclusion. What the remaining pairs share is read from the groups of `shared_values`.
    `coverage` is the share of the key's values that are found.
    """
    shape = ["table_name", "column_name", "normalized_type", "n_distinct", "min_value", "max_value", "is_key"]
    source = profiles.where("n_distinct > 0 and normalized_type not in ('json', 'unknown')").select(
        *[F.col(c).alias(f"from_{c}") for c in shape]
    )
    target = profiles.where("is_key").select(*[F.col(c).alias(f"to_{c}") for c in shape])
    other = (F.col("from_table_name") != F.col("to_table_name")) | (F.col("from_column_name") != F.col("to_column_name"))
    integers = F.col("from_normalized_type") == "integer"

    def number(c: str) -> Column:
        return F.expr(f"try_cast({c} as decimal(38,0))")

    inside = (number("from_min_value") >= number("to_min_value")) & (number("from_max_value") <= number("to_max_value"))
    overlap = (number("from_min_value") <= number("to_max_value")) & (number("from_max_value") >= number("to_min_value"))
    possible = F.when(integers, inside if minimum >= 1.0 else overlap).otherwise(True)
    # half a unit of the last place to which containment is rounded
    possible = possible & (F.col("from_n_distinct") * F.lit(min(minimum, 1.0) - 5e-7) <= F.col("to_n_distinct"))
    pairs = source.join(target, (F.col("from_normalized_type") == F.col("to_normalized_type")) & other & possible).select(
        "from_table_name", "from_column_name", "to_table_name", "to_column_name", "from_n_distinct", "to_n_distinct"
    )
    pairs = cut(pairs)  # column names, used twice
    found = shared_values(values, pairs).join(pairs, COLUMN_PAIR).withColumnsRenamed(
        {"from_n_distinct": "n_values", "to_n_distinct": "n_keys"})
    ratio = F.round(F.col("n_matched") / F.col("n_values"), 6)
    return found.select(
        F.col("from_table_name").alias("from_table"),
        F.col("from_column_name").alias("from_column"),
        F.col("to_table_name").alias("to_table"),
        F.col("to_column_name").alias("to_column"),
        "n_values",
        "n_matched",
        ratio.alias("containment"),
        F.round(F.col("n_matched") / F.col("n_keys"), 6).alias("coverage"),
    ).where(F.col("containment") >= minimum)


COLUMN_PAIR = ["from_table_name", "from_column_name", "to_table_name", "to_column_name"]


def value_groups(values: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """(normalized_type, holders, n): how many distinct values are held by exactly these of the given columns.

    A value is grouped once, whatever the number of columns or pairs: its holders are a bitmap, one bit a column in
    64-bit words, and values with equal bitmaps are then counted. The groups are few, however many values there are.
    """
    numbered = values.sparkSession.createDataFrame(
        [(t, c, i // 64, i % 64) for i, (t, c) in enumerate(columns)], "table_name string, column_name string, word int, bit int")
    value = plain_number(F.col("normalized_type"), F.col("value")).alias("value")
    known = values.join(F.broadcast(numbered), ["table_name", "column_name"]).select(
        "normalized_type", value, "word", F.expr("shiftleft(1L, bit)").alias("mark"))
    words = [F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("mark"))), F.lit(0).cast("long")).alias(f"w{w}")
             for w in range(-(-len(columns) // 64))]
    held = known.groupBy("normalized_type", "value").agg(*words)
    names = [f"w{w}" for w in range(len(words))]
    return held.groupBy("normalized_type", *names).agg(F.count("*").alias("n")).select(
        "normalized_type", F.array(*names).alias("holders"), "n")


def holds(words: Column, i: Column) -> Column:
    """Whether the i-th bit is set in a bitmap of 64-bit words."""
    return F.getbit(F.element_at(words, (i / 64).cast("int") + 1), i % 64) == 1


def shared_values(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (from_/to_ table and column names) that share values, and how many distinct ones (`n_matched`).

    Both columns of a pair have one type. Pairs and columns are metadata; the values are shuffled once.
    """
    ends = [pairs.select(F.col(f"{side}_table_name").alias("t"), F.col(f"{side}_column_name").alias("c")) for side in ("from", "to")]
    columns = sorted((r.t, r.c) for r in ends[0].union(ends[1]).distinct().collect())  # column names only
    if not columns:
        return pairs.select(*COLUMN_PAIR, F.lit(0).cast("long").alias("n_matched")).limit(0)
    spark = values.sparkSession
    numbered = spark.createDataFrame([(t, c, i) for i, (t, c) in enumerate(columns)], "t string, c string, i int")
    asked = pairs.select(*COLUMN_PAIR)
    for side in ("from", "to"):
        asked = asked.join(numbered.select(
            F.col("t").alias(f"{side}_table_name"), F.col("c").alias(f"{side}_column_name"), F.col("i").alias(f"{side}_i")),
            [f"{side}_table_name", f"{side}_column_name"])

    def held(i: str) -> str:
        return f"(shiftright(element_at(holders, int({i} div 64 + 1)), int({i} % 64)) & 1L) = 1L"

    groups = value_groups(values, columns)
    sources = groups.withColumn("from_i", F.explode(F.expr(f"filter(sequence(0, {len(columns) - 1}), i -> {held('i')})")))
    both = sources.join(asked, "from_i").where(F.expr(held("to_i")))
    return both.groupBy(*COLUMN_PAIR).agg(F.sum("n").alias("n_matched"))


def plain_number(normalized_type: Column, value: Column) -> Column:
    """Numbers without exponents and without zeros at the end of their fraction, so that equal ones are equal as text,
    whatever their scale and type."""
    written = F.when(value.contains("E"), F.coalesce(value.try_cast("decimal(38,12)").cast("string"), value)).otherwise(value)
    shortened = F.regexp_replace(F.regexp_replace(written, r"^(-?[0-9]+\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(normalized_type == "numeric", shortened).otherwise(value)


def cardinalities(values: DataFrame, base_name: Column) -> DataFrame:
    """Columns of one bare name and type in two tables: shared values, the largest group per side, and the kind of link.

    values: table_name, column_name, normalized_type, value, n. A value meets the columns of its own name only, and those of
    a name that one table has alone stay out. Values grow with the tables, so they are merged, never broadcast.
    """
    listed = cut(values.select("table_name", "column_name", "normalized_type").distinct().withColumn("base_name", base_name))
    several = listed.groupBy("base_name", "normalized_type").agg(F.count_distinct("table_name").alias("n_tables")).where("n_tables > 1")
    named = listed.join(several.withColumn("name", F.struct("base_name", "normalized_type")), ["base_name", "normalized_type"])
    # numbers stand for names and columns in the shuffle
    numbered = cut(named.select("table_name", "column_name", "normalized_type", F.dense_rank().over(Window.orderBy("name")).alias("name"),
                                F.row_number().over(Window.orderBy("table_name", "column_name", "normalized_type")).alias("place")))
    value = plain_number(F.col("normalized_type"), F.col("value")).alias("value")
    known = values.join(F.broadcast(numbered), ["table_name", "column_name", "normalized_type"]).select("name", value, "place", "n")
    a = known.select("name", "value", F.col("place").alias("a"), F.col("n").alias("n_from"))
    b = known.select("name", "value", F.col("place").alias("b"), F.col("n").alias("n_to"))
    # places are in the order of tables, so each two columns meet once; values tell rows apart sooner than names when they are sorted
    met = cut(a.join(b.hint("merge"), ["value", "name"]).where("a < b").groupBy("a", "b").agg(
        F.count("*").alias("n_shared_keys"), F.max("n_from").alias("max_from"), F.max("n_to").alias("max_to")))  # column pairs
    sides = [numbered.select(F.col("place").alias(p), F.col("table_name").alias(f"{side}_table"), F.col("column_name").alias(f"{side}_column"))
             for p, side in (("a", "from"), ("b", "to"))]
    shared = met.join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b").where("from_table < to_table").select(
        "from_table", "from_column", "to_table", "to_column", "n_shared_keys", "max_from", "max_to")
    kind = F.when((F.col("max_from") > 1) & (F.col("max_to") > 1), "many_to_many").otherwise("one_to_many")
    return shared.withColumn("relationship_type", kind)


def key_counts(df: DataFrame, key: str | Column, alias: str = "key") -> DataFrame:
    """(key, n): rows per non-null key; the one place a hot key is reduced to one row."""
    column = F.col(key) if isinstance(key, str) else key
    return df.select(column.alias(alias)).where(F.col(alias).isNotNull()).groupBy(alias).agg(F.count("*").alias("n"))


def orphans(child: DataFrame, child_key: str | Column, parent: DataFrame, parent_key: str | Column) -> DataFrame:
    """One row: child rows, rows and distinct keys without a parent, and the ratio. NULL keys are no orphans.

    Both sides are grouped by key first, so the join meets every key once.
    """
    counted = key_counts(child, child_key)
    known = key_counts(parent, parent_key).select("key", F.lit(1).alias("known"))
    lost = F.col("known").isNull()
    totals = counted.join(known, "key", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("n_orphan_rows"),
        F.count(F.when(lost, 1)).alias("n_orphan_keys"),
    )
    return totals.withColumn("orphan_ratio", F.round(F.try_divide(F.col("n_orphan_rows"), F.col("n_rows")), 6))


def missing_counterparts(source: DataFrame, key: str | Column, other: DataFrame, other_key: str | Column,
                         condition: str | None = None) -> DataFrame:
    """Whole source rows (optionally filtered) with no row of that key in the sibling system.

    Rows without a key have no counterpart; they bypass the join, in which they would all meet in one task.
    """
    rows = source.where(condition) if condition else source
    left = F.col(key) if isinstance(key, str) else key
    present = key_counts(other, other_key, "__key").select("__key")
    keyed = rows.withColumn("__key", left)
    lost = keyed.where("__key is not null").join(present, "__key", "left_anti").drop("__key")
    return lost.unionByName(keyed.where("__key is null").drop("__key"))


def spellings(df: DataFrame, name: str | Column) -> DataFrame:
    """(block, canonical, n_spellings, n_rows, example): raw names reduced to canonical ones."""
    raw = F.col(name) if isinstance(name, str) else name
    counted = df.select(raw.alias("raw")).where("raw is not null").groupBy("raw").agg(F.count("*").alias("n"))
    return (
        counted.withColumn("block", block_key(F.col("raw"))).withColumn("canonical", canonical_name(F.col("raw")))
        .groupBy("block", "canonical")
        .agg(F.count("*").alias("n_spellings"), F.sum("n").alias("n_rows"), F.min("raw").alias("example"))
    )


def fuzzy_matches(left: DataFrame, left_name: str | Column, right: DataFrame, right_name: str | Column,
                  max_distance: int = 1) -> DataFrame:
    """Canonical names of both sides with the same first four letters, within an edit distance.

    Candidates come from shared deletion keys, of which a name of length m has
    about m for distance 1; a key is shared by few names however many start alike,
    so a crowded block costs no more than its size. Nothing is capped or skipped.
    """
    a = spellings(left, left_name).select("block", *[F.col(c).alias(f"left_{c}") for c in ("canonical", "n_spellings", "n_rows", "example")])
    b = spellings(right, right_name).select("block", *[F.col(c).alias(f"right_{c}") for c in ("canonical", "n_spellings", "n_rows", "example")])
    candidates = a.withColumn("deletion", F.explode(deletion_keys(F.col("left_canonical"), max_distance))).join(
        b.withColumn("deletion", F.explode(deletion_keys(F.col("right_canonical"), max_distance))), ["block", "deletion"]
    ).drop("deletion")
    distance = F.levenshtein(F.col("left_canonical"), F.col("right_canonical"))
    return (
        candidates.withColumn("distance", distance).where(F.col("distance") <= max_distance)
        .dropDuplicates(["block", "left_canonical", "right_canonical"])
    )


def derived_links(source: DataFrame, text: str, pattern: str, target: DataFrame, target_key: str, group: int = 1,
                  key_type: str = "string") -> DataFrame:
    """(n_rows, n_extracted, n_linked): a reference cut out of free text and looked up in the target's key."""
    extracted = F.nullif(F.regexp_extract(F.col(text), pattern, group), F.lit("")).try_cast(key_type)
    keyed = source.select(extracted.alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    known = key_counts(target, target_key).select("key", F.lit(1).alias("known"))
    n = F.col("n")
    return keyed.join(known, "key", "left").agg(
        F.sum(n).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("key").isNotNull(), n)), F.lit(0)).alias("n_extracted"),
        F.coalesce(F.sum(F.when(F.col("known") == 1, n)), F.lit(0)).alias("n_linked"),
    )


def join_derived(source: DataFrame, text: str, pattern: str, target: DataFrame, target_key: str, group: int = 1,
                 key_type: str = "string") -> DataFrame:
    """The rows themselves: source columns, the extracted `reference`, target columns."""
    extracted = F.nullif(F.regexp_extract(F.col(text), pattern, group), F.lit("")).try_cast(key_type)
    keyed = source.withColumn("reference", extracted)
    return keyed.join(target, keyed["reference"] == target[target_key])


def link_cardinality(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """One row: the largest group per side over shared keys, and one_to_many or many_to_many."""
    a = key_counts(left, left_key).withColumnRenamed("n", "n_left")
    b = key_counts(right, right_key).withColumnRenamed("n", "n_right")
    shared = a.join(b, "key").agg(
        F.count("*").alias("n_shared_keys"), F.max("n_left").alias("max_left"), F.max("n_right").alias("max_right")
    )
    kind = F.when((F.col("max_left") > 1) & (F.col("max_right") > 1), "many_to_many").when(
        F.col("n_shared_keys") > 0, "one_to_many"
    )
    return shared.withColumn("relationship_type", kind)


def unlinked_dimensions(dimensions: DataFrame, columns: DataFrame, overlaps: DataFrame, links: DataFrame) -> DataFrame:
    """Dimensions whose bare name no other table has and that no relationship holds, with the best value overlap as a hint.

    dimensions: table_name, column_name, base_name;  columns: table_name, base_name of all columns, keys too;
    overlaps: from_/to_ columns and containment;  links: from_/to_ columns of relationships
    """
    alone = columns.groupBy("base_name").agg(F.count_distinct("table_name").alias("n_tables")).where("n_tables = 1").select("base_name")
    related = links.select(F.col("from_table").alias("table_name"), F.col("from_column").alias("column_name")).unionByName(
        links.select(F.col("to_table").alias("table_name"), F.col("to_column").alias("column_name")))
    homes = dimensions.join(alone, "base_name").join(related, ["table_name", "column_name"], "left_anti")
    best = overlaps.groupBy("from_table", "from_column").agg(
        F.max_by(F.struct("to_table", "to_column", "containment"), F.struct("containment", "to_table", "to_column")).alias("hint")
    )
    joined = homes.join(best, (homes["table_name"] == best["from_table"]) & (homes["column_name"] == best["from_column"]), "left")
    return joined.select(
        F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"),
        F.col("hint.to_table").alias("to_table"), F.col("hint.to_column").alias("to_column"),
        F.lit("unlinked_dimension").alias("relationship_type"),
    )


def value_overlaps(values: DataFrame) -> DataFrame:
    """Containment between all given columns of equal type that share a value, keys or not.

    Each value is grouped once (`shared_values`), so a value that most columns hold costs no more than a row per column.
    """
    columns = cut(values.groupBy("table_name", "column_name", "normalized_type").agg(F.count("*").alias("n_values")))
    a = columns.select(F.col("table_name").alias("from_table_name"), F.col("column_name").alias("from_column_name"), "normalized_type", "n_values")
    b = columns.select(F.col("table_name").alias("to_table_name"), F.col("column_name").alias("to_column_name"), "normalized_type")
    other = (F.col("from_table_name") != F.col("to_table_name")) | (F.col("from_column_name") != F.col("to_column_name"))
    pairs = cut(a.join(b, "normalized_type").where(other))  # column names
    return shared_values(values, pairs).join(pairs, COLUMN_PAIR).select(
        F.col("from_table_name").alias("from_table"), F.col("from_column_name").alias("from_column"),
        F.col("to_table_name").alias("to_table"), F.col("to_column_name").alias("to_column"), "n_matched", "n_values",
        F.round(F.col("n_matched") / F.col("n_values"), 6).alias("containment"))
