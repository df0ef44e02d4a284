"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source is to give target / size copies of each of its documents. The whole part is certain; the fraction is a
probability that is rounded to 0 or 1. Two documents of a source exchange mass, one up and the other down by the same
number of words, until one of the two is whole; which of the two possible exchanges happens is drawn so that no
document's probability changes on average. The sum of words stays exact throughout.

The exchanges run through a reduction tree: documents are dealt to blocks of bounded size, a block leaves at most one
document that is not whole, these meet in blocks of the next level, and so on until one per source is left, which is
rounded. A hot source only has more blocks. All draws are hashes of document numbers, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.llm.groups import by_place
from assayer.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5  # words of the mix for each word of the input
MOST_COPIES = 2.0
BLOCK = 128  # documents of a block, on average
SALTS = 64
SEED = 20
WHOLE = 1e-9  # closer than this to 0 or 1 is whole


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def measured(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    """doc_id, source, size, a salt and the number of the row among those of its doc_id; texts are read this once."""
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    repeat = F.row_number().over(Window.partitionBy("doc_id").orderBy("source", "size"))
    return cut(narrow.withColumn("_row", repeat).withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id", "_row"), F.lit(SALTS)).cast("int")))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Adds `target` to (source, source_size).

    The weights repeat over the sources by code point, null last. Shares stop at `most` times a source's size and the
    excess is shared anew by weight until none is above. Every round is one small aggregate, which caps at least one
    further source or ends.
    """
    # numbered through a range partitioning: no task sorts all sources
    ordered = cut(
        sources.repartitionByRange(F.col("source").isNull().asc(), F.col("source").asc())
        .sortWithinPartitions(F.col("source").isNull().asc(), F.col("source").asc())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part, at = F.shiftright("_at", 33), F.expr("_at & 8589934591L")
    before, starts = 0, []
    for row in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row per partition
        starts += [before] * (row["part"] + 1 - len(starts))
        before += row["count"]
    first = F.get(F.array(*[F.lit(n) for n in starts or [0]]), part.cast("int"))
    numbered = ordered.withColumn("_index", first + at)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_index") % len(weights) + 1).cast("int"))
    weighted = cut(numbered.select("source", "source_size", weight.alias("_weight")))

    cap = F.col("source_size") * F.lit(most)
    level, capped_before = 0.0, -1
    while True:
        capped = F.col("_weight") * F.lit(level) >= cap
        row = weighted.agg(
            F.sum("source_size").alias("words"), F.count_if(capped).alias("n_capped"),
            F.sum(F.when(capped, cap)).alias("taken"), F.sum(F.when(~capped, F.col("_weight"))).alias("weight"),
        ).first()
        if row["n_capped"] == capped_before or not row["weight"]:
            break
        capped_before = row["n_capped"]
        level = (row["words"] * share - (row["taken"] or 0.0)) / row["weight"]
    return weighted.select("source", "source_size", F.least(cap, F.col("_weight") * F.lit(level)).alias("target"))


# One document of a block as an array element: its number and row, its words, and p, the probability of one more copy.
DOC = "struct<doc_id:bigint,_row:int,size:bigint,p:double>"
NONE = f"cast(null as {DOC})"


def _fold(level: int) -> str:
    """SQL for the exchanges of one block: an array of documents to (done: documents whose p is 0 or 1, rest: one or none).

    With a and b the words of the two documents and p and q their probabilities, words may go from b to a until a is
    full or b is empty, or from a to b until a is empty or b is full. Each of the two happens with the other's share.
    """
    up = "least(acc.rest.size * (1 - acc.rest.p), x.size * x.p)"
    down = "least(acc.rest.size * acc.rest.p, x.size * (1 - x.p))"
    unit = f"(pmod(xxhash64(acc.rest.doc_id, acc.rest._row, x.doc_id, x._row, {SEED + level}), {1 << 53}L) / cast({1 << 53} as double))"
    moved = f"if({unit} * ({up} + {down}) < {down}, {up}, -({down}))"

    def snapped(p: str) -> str:
        return f"if({p} < {WHOLE}, 0D, if({p} > {1 - WHOLE}, 1D, {p}))"

    def whole(p: str) -> str:
        return f"({p} = 0D or {p} = 1D)"

    # one lambda argument per step stands for a local variable
    p_new = snapped("acc.rest.p + m / acc.rest.size")
    q_new = snapped("x.p - m / x.size")
    first = f"named_struct('doc_id', acc.rest.doc_id, '_row', acc.rest._row, 'size', acc.rest.size, 'p', {p_new})"
    second = f"named_struct('doc_id', x.doc_id, '_row', x._row, 'size', x.size, 'p', {q_new})"
    step = f"transform(array({moved}), m -> array({first}, {second}))[0]"
    settle = (
        "transform(array(" + step + "), pair -> named_struct("
        f"'done', concat(acc.done, filter(pair, y -> {whole('y.p')})), "
        # both may become whole at once, where their words and probabilities add up
        f"'rest', get(filter(pair, y -> not {whole('y.p')}), 0)))[0]"
    )
    alone = "named_struct('done', acc.done, 'rest', x)"
    return (
        f"aggregate(docs, named_struct('done', cast(array() as array<{DOC}>), 'rest', {NONE}), "
        f"(acc, x) -> if(acc.rest is null, {alone}, {settle}))"
    )


def mix(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES,
    text: str = "text", doc_id: str = "doc_id", source: str = "source", block: int = BLOCK,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken = size * copies.

    `size` counts words (null: 0). Documents without words have no copies. Null sources are one source, the last;
    repeated rows are rounded on their own. An empty table gives an empty result. Other columns are not read.
    """
    return _mixed(docs, weights, share, most, text, doc_id, source, block).drop("_row")


def _mixed(docs: DataFrame, weights, share: float, most: float, text: str, doc_id: str, source: str, block: int) -> DataFrame:
    """`mix` with the number of the row among those of its doc_id."""
    rows = measured(docs, text, doc_id, source)
    # sums of (source, salt) first: a hot source is combined in parts, and its documents later meet its parts
    parts = cut(rows.groupBy("source", "_salt").agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_docs")))
    totals = parts.groupBy("source").agg(F.sum("_size").alias("source_size"), F.sum("_docs").alias("_docs"))
    shares = targets(totals.select("source", "source_size"), weights, share, most)
    totals = totals.select("source", "_docs")
    known = shares.withColumnRenamed("source", "s").join(totals, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    by_part = parts.select(F.col("source").alias("s"), "_salt").join(known, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    joined = rows.join(
        by_part.withColumnRenamed("source", "s").withColumnRenamed("_salt", "_part"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("_salt") == F.col("_part")),
    ).drop("s", "_part", "_salt")
    copies = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    fraction = copies - F.floor(copies)
    near_up, near_down = fraction > 1 - WHOLE, fraction < WHOLE
    settled = joined.withColumns({
        "_sure": (F.floor(copies) + F.when(near_up, 1).otherwise(0)).cast("long"),
        "_p": F.when(near_up | near_down, 0.0).otherwise(fraction),
    })
    # whole copies need no rounding; the others are dealt to blocks
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_docs") / F.lit(block))).cast("long")
    prepared = cut(settled.select(
        "doc_id", "_row", "source", "size", "source_size", "target", "_sure", "_p", "_docs",
        F.pmod(F.xxhash64("doc_id", "_row", F.lit(SEED)), blocks).alias("_block")))
    more = _round(prepared.where("_p > 0"), block)
    more = more.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_number"), "_more")
    # a row per open document: too much to broadcast, however small its files are
    result = prepared.join(more.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_number")), "left")
    copies = F.col("_sure") + F.coalesce(F.col("_more"), F.lit(0))
    return result.select(
        "doc_id", "_row", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _round(open_docs: DataFrame, block: int) -> DataFrame:
    """doc_id, _row and _more (0 or 1) of every document that is open."""
    element = F.struct("doc_id", "_row", "size", F.col("_p").alias("p"))
    docs = open_docs.select("source", "_block", element.alias("doc"))
    most = open_docs.agg(F.max("_docs")).first()[0] or 0
    done, level = [], 0
    while True:
        # ordered by a hash, so that no order of input shows; a block holds `block` documents on average
        ordered = F.array_sort(F.collect_list(F.struct(F.xxhash64("doc.doc_id", "doc._row", F.lit(level)).alias("h"), "doc")))
        folded = cut(
            docs.groupBy("source", "_block").agg(F.transform(ordered, lambda d: d["doc"]).alias("docs"))
            .select("source", "_block", F.expr(_fold(level)).alias("f"))
            .select("source", "_block", "f.done", "f.rest")
        )
        done.append(folded.select(F.explode("done").alias("d")).select("d.doc_id", "d._row", F.col("d.p").cast("int").alias("_more")))
        rest = folded.where("rest is not null")
        most = -(-most // block)
        if most <= 1:
            break
        # blocks of this level that share a quotient meet in one block of the next
        docs = rest.select("source", F.floor(F.col("_block") / block).alias("_block"), F.col("rest").alias("doc"))
        level += 1
    # one document per source is left; to the nearest, so that a source is off by half a document at most
    last = rest.select("rest.doc_id", "rest._row", F.round("rest.p").cast("int").alias("_more"))
    for part in done:
        last = last.unionByName(part)
    return last


def take(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES,
    text: str = "text", doc_id: str = "doc_id", source: str = "source", block: int = BLOCK,
) -> DataFrame:
    """The mix itself: every row as often as the mix takes it, with its own columns, whatever their names.

    Nulls, texts without words, repeated rows and empty tables are treated as in `mix`.
    """
    plain, (text, doc_id, source) = by_place(docs, text, doc_id, source)
    picked = _mixed(plain, weights, share, most, text, doc_id, source, block).where("copies > 0").select(
        F.col("doc_id").alias("_mix_id"), F.col("_row").alias("_mix_number"), F.col("copies").alias("_mix_copies"))
    # numbered as in `measured`; rows that agree in source and size may change places there, the text orders them here
    repeat = F.row_number().over(Window.partitionBy(F.col(doc_id)).orderBy(
        F.col(source), word_count(F.col(text)), F.xxhash64(F.col(text))))
    same = F.col(doc_id).eqNullSafe(F.col("_mix_id")) & (F.col("_mix_row") == F.col("_mix_number"))
    return plain.withColumn("_mix_row", repeat).join(picked, same).withColumn(
        "_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*plain.columns).toDF(*docs.columns)
