"""Exact deduplication with skew-safe combining, in DataFrame functions only.

Equal texts are combined in three steps: within each task, within each of the 64 salts of a digest, and over the
salts. Every step groups by digest and by the whole text, so content is compared, never digests alone. The rows then
meet their group by digest and salt, so that no key holds more than a 64th of a group of copies.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.llm.groups import by_place

SALTS = 64  # one bit each of a 64-bit mask

GROUP_KEY = ["_digest", "_check", "_salt"]


def normalised(text: Column) -> Column:
    """A-Z in lower case and nothing else; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    # lower() would also change letters beyond ASCII; without such letters it does the same and is faster
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Adds the normalised text, its digests, and a salt that depends on the document's number alone."""
    return docs.withColumn("_text", normalised(F.col(text))).withColumns({
        "_digest": F.unhex(F.sha2("_text", 256)),
        # a second hash, so that texts of one digest would still be told apart where rows meet their group
        "_check": F.xxhash64("_text"),
        "_salt": F.pmod(F.xxhash64(F.col(doc_id)), F.lit(SALTS)).cast("int"),
    })


def copy_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Groups of equal texts: _digest, _check, keep_id, group_size, and _mask, whose bits are the salts that occur."""
    rows = _keyed(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_raw")), "_raw", "_id")
    # Spark combines within each task before this first exchange
    salted = rows.groupBy("_digest", "_check", "_text", "_salt").agg(
        F.max("_id").alias("_largest"), F.count(F.lit(1)).alias("_n"))
    bit = F.expr("shiftleft(1L, _salt)")
    return salted.groupBy("_digest", "_check", "_text").agg(
        F.max("_largest").alias("keep_id"), F.sum("_n").alias("group_size"), F.bit_or(bit).alias("_mask")
    ).drop("_text")


def copy_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id is kept; null counts as smaller than any number. Of rows that repeat
    doc_id and text one is kept. Null and empty texts are equal. An empty table gives an empty result; other columns
    are not read, whatever their names.
    """
    rows = _keyed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_raw")), "_raw", "doc_id").select(
        "doc_id", *GROUP_KEY)
    groups = copy_classes(docs, text, doc_id).withColumn(
        "_salt", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(_mask, s) & 1L) = 1L)"))
    ).drop("_mask")
    joined = rows.join(groups, GROUP_KEY)
    # rows of one doc_id have one salt, so they are already together
    repeat = F.row_number().over(Window.partitionBy(*GROUP_KEY, "doc_id").orderBy("doc_id"))
    return joined.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (repeat == 1)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that copy_groups keeps, with all their columns, whatever their names. An empty table stays empty."""
    plain, (text, doc_id) = by_place(docs, text, doc_id)
    keepers = copy_classes(plain, text, doc_id).select(
        F.coalesce("keep_id", F.lit(0)).alias("_keep"), F.col("keep_id").isNull().alias("_null"), "_digest", "_check")
    rows = _keyed(plain, text, doc_id).drop("_text", "_salt").withColumns(
        {"_keep": F.coalesce(F.col(doc_id), F.lit(0)), "_null": F.col(doc_id).isNull()})
    key = ["_keep", "_null", "_digest", "_check"]
    kept = rows.join(keepers, key, "left_semi")
    repeat = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    return kept.withColumn("_repeat", repeat).where("_repeat = 1").select(*plain.columns).toDF(*docs.columns)
