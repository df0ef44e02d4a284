"""Links between columns that no equal values show, found without naming a column.

Names that are spelled differently: columns are matched name by name, except where too few of a column's names begin
like any of the other column's to be its spellings. References inside texts: the tokens of every text column are grouped by
their shape, and shapes that most rows have are probed against all keys.

Values are counted first (`profile.value_counts`), so one that fills a column is looked at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.functions.cells import quoted
from assayer.functions.names import block_key, canonical_name, deletion_keys
from assayer.functions.types import normalize_spark
from assayer.operators.relations import COLUMN_PAIR, holds, shared_values
from assayer.session import cut

SHORT = 128  # longer values are no names; value counts hold them as digests
COLUMN = ["table_name", "column_name"]


# ---- one name, several spellings ----

def canonical_names(values: DataFrame) -> DataFrame:
    """table_name, column_name, block, canonical: distinct canonical names of text columns, with the block they fall in."""
    short = values.where((F.col("normalized_type") == "string") & (F.length("value") <= SHORT)).withColumn("block", block_key(F.col("value")))
    # a generator, so that names are not worked out again by the filter below
    named = short.where("length(block) = 4").select(*COLUMN, "block", F.explode(F.array(canonical_name(F.col("value")))).alias("canonical"))
    return named.where("canonical is not null").distinct()


def _columns(df: DataFrame) -> list[tuple[str, str]]:
    """Tables and columns met in `df`, which holds few rows."""
    return sorted((r.table_name, r.column_name) for r in df.select(*COLUMN).distinct().collect())


def _numbered(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """(table_name, column_name, i): the columns and their places in a bitmap."""
    return df.sparkSession.createDataFrame([(t, c, i) for i, (t, c) in enumerate(columns)], "table_name string, column_name string, i int")


def _ends(numbered: DataFrame) -> list[DataFrame]:
    """What from_i and to_i stand for."""
    return [F.broadcast(numbered.select(F.col("i").alias(f"{side}_i"), *[F.col(c).alias(f"{side}_{c}") for c in COLUMN])) for side in ("from", "to")]


def _bitmap(columns: list[tuple[str, str]]) -> list[Column]:
    """w0, w1, ...: one bit a column, over the rows of a group with `i`."""
    return [F.bit_or(F.expr(f"if(i div 64 = {w}, shiftleft(1L, i % 64), 0L)")).alias(f"w{w}") for w in range(-(-len(columns) // 64))]


def _members(columns: list[tuple[str, str]], bitmap: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: holds(bitmap, i))


def similar_columns(names: DataFrame, minimum: float) -> DataFrame:
    """Ordered pairs (from_/to_ table and column names) of columns that may have enough close names. None that has is left out.

    Close names share a block, so no more of a column's names can have a close one in the other column than lie in blocks
    that the other column has as well. Blocks are counted by column, then by the columns that hold them.
    """
    sized = cut(names.groupBy(*COLUMN, "block").agg(F.count("*").alias("n")))
    columns = _columns(sized)
    if not columns:
        return names.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in COLUMN_PAIR))
    numbered = _numbered(names, columns)
    bitmap = _bitmap(columns)
    held = sized.join(F.broadcast(numbered), COLUMN).groupBy("block").agg(F.collect_list(F.struct("i", "n")).alias("columns"), *bitmap)  # a row a column
    alike = held.select(F.inline("columns"), F.array(*[f"w{w}" for w in range(len(bitmap))]).alias("holders")).groupBy("i", "holders").agg(F.sum("n").alias("n"))
    alike = cut(alike.select(F.col("i").alias("from_i"), "holders", "n"))
    most = alike.select("from_i", F.explode(_members(columns, F.col("holders"))).alias("to_i"), "n").groupBy("from_i", "to_i").agg(F.sum("n").alias("most"))
    whole = alike.groupBy("from_i").agg(F.sum("n").alias("n_names"))
    enough = most.where("from_i <> to_i").join(whole, "from_i").where(F.round(F.col("most") / F.col("n_names"), 6) >= minimum)
    ends = _ends(numbered)
    return enough.join(ends[0], "from_i").join(ends[1], "to_i").select(*COLUMN_PAIR)


def _without(name: Column, i: Column) -> Column:
    """The name without its i-th character."""
    return F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name)))


def _one_apart(one: DataFrame, words: list[str]) -> DataFrame:
    """(block, canonical, words, r words): names with a name of other columns at distance 1, and the columns that hold one.

    Two names are one apart if both, or one of them, lose the i-th character and the same is left. So all names around what
    is left and a place are close to each other, as many as there are characters: they are grouped, never paired. Before that,
    names are grouped by the half of it that lies before or behind the place; only halves that names of different columns
    have in common are looked at place by place. Hashes only select; equal texts decide.
    """
    name, length = F.col("canonical"), F.length("canonical")
    left, half = F.col("left"), F.expr("left div 2")
    tail = left - half
    # `left`: the length of what is left, which is one less than the name's or, for the shorter of two, the name's
    halves = F.array(F.struct(F.lit(True).alias("behind"), F.substring(name, F.lit(1), half).alias("part")),
                     F.struct(F.lit(False).alias("behind"), F.substring(name, length - tail + 1, tail).alias("part")))
    cut_in_two = one.withColumn("left", F.explode(F.array(length - 1, length))).select("*", F.inline(halves))
    keyed = cut_in_two.withColumn("key", F.xxhash64("block", "left", "behind", "part")).drop("part")
    mixed = cut(keyed.groupBy("key").agg(
        *[F.bit_or(w).alias(f"any_{w}") for w in words], *[F.bit_and(w).alias(f"all_{w}") for w in words]
    ).where(reduce(Column.__or__, [F.col(f"any_{w}") != F.col(f"all_{w}") for w in words])).select("key"))
    places = F.filter(F.sequence(F.lit(1), left + 1), lambda i: F.when(F.col("behind"), i > half).otherwise(i <= half))
    placed = keyed.join(mixed, "key", "left_semi").select("block", "canonical", *words, "left", F.explode(places).alias("i"))
    rest = F.when(left < length, _without(name, F.col("i"))).otherwise(name)
    around = placed.withColumn("rest", rest).withColumn("key", F.xxhash64("block", "i", "rest"))
    group = Window.partitionBy("key", "block", "i", "rest")  # no more names than there are characters
    seen = around.select("*", *[F.bit_or(w).over(group).alias(f"r{w}") for w in words])
    more = seen.where(reduce(Column.__or__, [F.col(f"r{w}") != F.col(w) for w in words]))
    return more.groupBy("block", "canonical").agg(*[F.bit_or(c).alias(c) for w in words for c in (w, f"r{w}")])


def _some_apart(one: DataFrame, words: list[str], max_distance: int) -> DataFrame:
    """The same for any distance: names that share a deletion key are compared. Names and keys grow with the tables, and are
    many times larger than the files they come from, so the joins are merged and none is broadcast."""
    keyed = one.withColumn("key", F.explode(deletion_keys(F.col("canonical"), max_distance)))
    a = keyed.select("block", "key", F.col("canonical").alias("left"), *words)
    b = keyed.select("block", "key", F.col("canonical").alias("right"), *[F.col(w).alias(f"r{w}") for w in words])
    differ = reduce(Column.__or__, [F.col(w) != F.col(f"r{w}") for w in words])
    near = (F.col("left") != F.col("right")) & (F.levenshtein("left", "right") <= max_distance)
    met = a.join(b.hint("merge"), ["block", "key"]).where(differ & near)
    return met.groupBy("block", F.col("left").alias("canonical")).agg(*[F.bit_or(c).alias(c) for w in words for c in (w, f"r{w}")])


def close_names(names: DataFrame, pairs: DataFrame, max_distance: int = 1) -> DataFrame:
    """The pairs, with `n_names` of the from-column and `n_matched` of them that have a close name in the to-column.

    A canonical name is looked at once, however many columns hold it: its columns are a bitmap, in 64-bit words, to which
    the columns of close names are added. Names that agree in both bitmaps are then counted, and only these few groups
    meet the pairs.
    """
    columns = _columns(reduce(DataFrame.union, [pairs.select(*[F.col(f"{side}_{c}").alias(c) for c in COLUMN]) for side in ("from", "to")]))
    if not columns:
        return pairs.sparkSession.createDataFrame([], ", ".join([*[f"{c} string" for c in COLUMN_PAIR], "n_matched bigint", "n_names bigint"]))
    numbered = _numbered(pairs, columns)
    bitmap = _bitmap(columns)
    words = [f"w{w}" for w in range(len(bitmap))]
    one = cut(names.join(F.broadcast(numbered), COLUMN).groupBy("block", "canonical").agg(*bitmap))
    held = F.array(*words).alias("held")
    groups = one.groupBy(*words).agg(F.count("*").alias("n")).select(held, held.alias("met"), "n", F.lit(True).alias("whole"))
    if max_distance > 0:
        near = _one_apart(one, words) if max_distance == 1 else _some_apart(one, words, max_distance)
        more = [F.col(f"r{w}").bitwiseAND(F.bitwise_not(w)).alias(f"r{w}") for w in words]
        gained = near.select(*words, *more).groupBy(*words, *[f"r{w}" for w in words]).agg(F.count("*").alias("n"))
        groups = groups.unionByName(gained.select(held, F.array(*[f"r{w}" for w in words]).alias("met"), "n", F.lit(False).alias("whole")))
    sources = cut(groups).withColumn("from_i", F.explode(_members(columns, F.col("held"))))
    asked = reduce(lambda df, end: df.join(end, [c for c in end.columns if c in COLUMN_PAIR]), _ends(numbered), pairs.select(*COLUMN_PAIR).distinct())
    matched = sources.join(asked, "from_i").where(holds(F.col("met"), F.col("to_i")) & (F.col("from_i") != F.col("to_i")))
    totals = sources.where("whole").groupBy("from_i").agg(F.sum("n").alias("n_names"))
    return matched.groupBy("from_i", *COLUMN_PAIR).agg(F.sum("n").alias("n_matched")).join(totals, "from_i").select(*COLUMN_PAIR, "n_matched", "n_names")


def fuzzy_links(values: DataFrame, minimum: float = 0.5, max_distance: int = 1) -> DataFrame:
    """from_table, from_column, to_table, to_column, n_names, n_matched, share: columns that hold the same names, spelled differently.

    At least `minimum` of the from-column's canonical names have a close one in the to-column, while some of its values
    are not there as they are written. Of both directions the one with the larger share is given.
    """
    names = cut(canonical_names(values))
    pairs = cut(similar_columns(names, minimum))
    found = close_names(names, pairs, max_distance).withColumn("share", F.round(F.col("n_matched") / F.col("n_names"), 6)).where(F.col("share") >= minimum)
    found = cut(found)
    written = values.groupBy(*[F.col(c).alias(f"from_{c}") for c in COLUMN]).agg(F.count("*").alias("n_values"))
    same = shared_values(values, found).withColumnRenamed("n_matched", "n_same").join(written, [f"from_{c}" for c in COLUMN]).where("n_same = n_values")
    loose = found.join(same, COLUMN_PAIR, "left_anti")
    # both directions of a pair are one group
    ends = [F.concat_ws(".", *[F.col(f"{s}_{c}") for c in COLUMN]) for s in ("from", "to")]
    best = Window.partitionBy(F.least(*ends), F.greatest(*ends)).orderBy(F.desc("share"), *COLUMN_PAIR)
    return loose.withColumn("place", F.row_number().over(best)).where("place = 1").select(
        *[F.col(c).alias(c.removesuffix("_name")) for c in COLUMN_PAIR], "n_names", "n_matched", "share")


# ---- references inside texts ----

TOKEN = r"[A-Za-z0-9]+(?:[-_/#.:][A-Za-z0-9]+)*"


def references(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, shape, reference, is_number, n, label, last_label: what in a text may refer to something else.

    A token with a digit in it as it stands, and a run of digits at its end as a number without leading zeros. The shape
    is the token with runs of letters as A and runs of digits as 9; the labels are the least and the largest of the letters
    that its tokens begin with. `n` counts rows; a text that holds a token twice
    counts once. Whole texts are read, but only their tokens leave the scan.
    """
    parts = []
    for table, df in tables.items():
        texts = [f.name for f in df.schema.fields if normalize_spark(f.dataType) == "string"]
        if texts:  # one scan a table
            cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(quoted(c)).alias("text")) for c in texts])).alias("cell"))
            tokens = F.filter(F.regexp_extract_all(F.col("cell.text"), F.lit(TOKEN), F.lit(0)), lambda t: t.rlike("[0-9]"))
            parts.append(cells.where(F.col("cell.text").rlike("[0-9]")).select(  # few texts hold a digit, and that is seen sooner than their tokens
                F.lit(table).alias("table_name"), "cell.column_name", F.explode(F.array_distinct(tokens)).alias("token")))
    counted = reduce(DataFrame.union, parts).groupBy(*COLUMN, "token").agg(F.count("*").alias("n"))
    shape = F.regexp_replace(F.regexp_replace("token", "[A-Za-z]+", "A"), "[0-9]+", "9")
    number = F.nullif(F.regexp_replace(F.regexp_extract("token", "([0-9]+)$", 1), "^0+(?=[0-9])", ""), F.lit(""))
    both = F.array(F.struct(F.col("token").alias("reference"), F.lit(False).alias("is_number")), F.struct(number.alias("reference"), F.lit(True).alias("is_number")))
    label = F.lower(F.regexp_extract("token", "^([A-Za-z]*)", 1)).alias("label")
    told = counted.select(*COLUMN, "n", "token", shape.alias("shape"), label)  # once a token, before there are two rows of it
    each = cut(told.select(*COLUMN, "n", "shape", "label", F.inline(both)).where("reference is not null"))
    # a token is one reference and is counted already; only numbers stand in several tokens. Their rows are sorted, as labels are
    # texts, and by a hash first, as the names before it are nearly all equal
    numbers = each.where("is_number").groupBy(F.xxhash64("reference").alias("mark"), "reference", "shape", *COLUMN).agg(
        F.sum("n").alias("n"), F.min("label").alias("label"), F.max("label").alias("last_label"))
    names = [*COLUMN, "shape", "reference", "is_number", "n", "label", "last_label"]
    return each.where("not is_number").withColumn("last_label", F.col("label")).select(*names).union(
        numbers.withColumn("is_number", F.lit(True)).select(*names))


MARK = "\1"  # between a column and a shape of its tokens


def reference_links(tables: dict[str, DataFrame], values: DataFrame, profiles: DataFrame, minimum: float = 0.9,
                    share: float = 0.5, covered: float = 0.5) -> DataFrame:
    """from_table, from_column, shape, to_table, to_column, n_rows, n_references, n_linked, n_keys: shapes of tokens inside a
    text column that name the values of another column.

    A shape counts if its tokens stand in at least `share` of the column's rows. It is linked if at least `minimum` of
    its distinct references are values of the other column. As any dense key holds small numbers, numbers must also name
    `covered` of these values, and all stand behind one label whose first four letters the table's or column's name holds
    (`Customer#17` and `o_custkey`). Tokens refer to text columns, numbers to whole-number columns. References and values
    are grouped once for all columns (`shared_values`), so no key column is probed by itself.
    """
    found = cut(references(tables))
    rows = profiles.select(*COLUMN, (F.col("n_rows") - F.col("n_nulls")).alias("n_filled"))
    # labels are few: rows are counted by them before they are sorted for the least and the largest
    labelled = found.groupBy(*COLUMN, "shape", "is_number", "label", "last_label").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_references"))
    common = labelled.groupBy(*COLUMN, "shape", "is_number").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_references").alias("n_references"), F.min("label").alias("label"), F.max("last_label").alias("last_label")
    ).join(rows, COLUMN)
    # a row per shape that most rows have
    common = cut(common.where(F.col("n_rows") >= F.lit(share) * F.col("n_filled")).withColumn(
        "kind", F.when(F.col("is_number"), "integer").otherwise("string")))
    place = F.concat(F.col("column_name"), F.lit(MARK), F.col("shape"))
    inside = found.join(common.select(*COLUMN, "shape", "is_number", "kind"), [*COLUMN, "shape", "is_number"]).select(
        "table_name", place.alias("column_name"), F.col("kind").alias("normalized_type"), F.col("reference").alias("value"))
    keys = profiles.where("normalized_type in ('integer', 'string') and n_distinct > 1").select(
        F.col("table_name").alias("to_table_name"), F.col("column_name").alias("to_column_name"), F.col("normalized_type").alias("kind"),
        F.col("n_distinct").alias("n_keys"))
    sources = common.select(F.col("table_name").alias("from_table_name"), "column_name", place.alias("from_column_name"), "shape", "kind", "n_rows", "n_references", "label", "last_label")
    other = (F.col("from_table_name") != F.col("to_table_name")) | (F.col("column_name") != F.col("to_column_name"))
    least = F.when(F.col("kind") == "integer", F.lit(covered) * F.col("n_keys")).otherwise(F.lit(1))
    named = (F.length("label") >= 3) & (F.col("label") == F.col("last_label")) & F.contains(
        F.lower(F.concat_ws(".", "to_table_name", "to_column_name")), F.left("label", F.lit(4)))
    # a pair per shape and column: metadata
    pairs = cut(sources.join(keys, "kind").where(
        other & ((F.col("kind") == "string") | named) & (F.lit(minimum) * F.col("n_references") <= F.col("n_keys")) & (F.col("n_references") >= least)))
    plain = values.where(F.col("normalized_type").isin("integer", "string")).select(*COLUMN, "normalized_type", "value")
    linked = shared_values(inside.unionByName(plain), pairs).join(pairs, COLUMN_PAIR).where(
        (F.col("n_matched") >= F.lit(minimum) * F.col("n_references")) & (F.col("n_matched") >= least))
    return linked.select(
        F.col("from_table_name").alias("from_table"), F.col("column_name").alias("from_column"), "shape", F.col("to_table_name").alias("to_table"),
        F.col("to_column_name").alias("to_column"), "n_rows", "n_references", F.col("n_matched").alias("n_linked"), "n_keys")
