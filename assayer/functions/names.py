"""Names of tables, definitions and companies."""

from pyspark.sql import Column, functions as F

from assayer.vocab import COMPANY_DESIGNATORS


def qualified(*parts: Column) -> Column:
    return F.concat_ws(".", *parts)


def split_qualified(name: Column) -> tuple[Column, Column]:
    """(schema, table) of `db.schema.table` or `schema.table`; NULLs for any other shape."""
    parts = F.split(name, r"\.")
    known = F.size(parts).isin(2, 3)
    return F.when(known, F.element_at(parts, -2)), F.when(known, F.element_at(parts, -1))


def is_machine_name(name: Column) -> Column:
    return name.rlike("^[a-z][a-z0-9_]*$")


def ends_in_number(name: Column) -> Column:
    """Soft rule: allowed, but worth a second look."""
    return name.rlike("[0-9]$")


def quoted_name(name: Column) -> Column:
    """A column's name as it stands in SQL: plain names as they are, others in backticks."""
    plain = name.rlike("^[A-Za-z_][A-Za-z0-9_]*$")
    return F.when(plain, name).otherwise(F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`")))


def block_key(name: Column) -> Column:
    """First four letters, upper-cased; spellings of one name nearly always share them."""
    return F.left(F.upper(F.regexp_replace(name, "[^A-Za-z]", "")), F.lit(4))


def canonical_name(name: Column, designators: list[str] = COMPANY_DESIGNATORS) -> Column:
    """Upper case, no punctuation, no trailing company designators, no blanks; NULL where nothing else is left."""
    words = F.trim(F.regexp_replace(F.upper(name), r"[^\p{L}\p{N}]+", " "))
    core = F.regexp_replace(words, f"( ({'|'.join(designators)}))+$", "")
    return F.nullif(F.regexp_replace(core, " ", ""), F.lit(""))


def deletion_keys(name: Column, distance: int) -> Column:
    """All strings left after removing up to `distance` characters.

    Two names within that edit distance share at least one such string, so an
    equi-join on these keys finds every close pair without comparing all pairs.
    """
    keys = F.array(name)
    for _ in range(distance):
        shorter = F.transform(
            keys,
            lambda s: F.transform(
                F.filter(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: i <= F.length(s)),
                lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))),
            ),
        )
        keys = F.array_distinct(F.concat(keys, F.flatten(shorter)))
    return keys
