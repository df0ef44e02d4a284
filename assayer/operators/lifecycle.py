"""Current state of definitions, folded from an append-only log of review decisions.

log: definition_id, at, seq, action, actor, reason [, fields MAP<STRING,STRING>]
actions: approve, reject, edit, reopen, supersede; (at, seq) orders the actions of one definition.

Only a reopen starts a new epoch, and inside an epoch the first approve or reject
decides. So the state before an action needs two running windows and no loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.session import cut
from assayer.vocab import EDITABLE_FIELDS

# A definition with more actions than this is spread over tasks instead of one window.
HOT_ACTIONS = 5_000_000

ORDER = ["at", "seq"]
BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, Window.currentRow)


def _is(action: str) -> Column:
    return F.col("action") == action


def _reached(verb: Column) -> Column:
    return F.when(verb == "approve", "approved").when(verb == "reject", "rejected").otherwise("proposed")


def _verb() -> Column:
    return F.when(F.col("action").isin("approve", "reject"), F.col("action"))


def _windowed(log: DataFrame, group: list[str]) -> DataFrame:
    """Adds `epoch` (reopens before the action) and `verb_before` (deciding verb of the epoch so far)."""
    ordered = Window.partitionBy(*group).orderBy(*ORDER)
    in_epoch = Window.partitionBy(*group, "epoch").orderBy(*ORDER)
    reopens = F.sum(_is("reopen").cast("int")).over(ordered.rowsBetween(*BEFORE))
    return log.withColumn("epoch", F.coalesce(reopens, F.lit(0))).withColumn(
        "verb_before", F.first(_verb(), ignorenulls=True).over(in_epoch.rowsBetween(*BEFORE))
    )


def _spread(log: DataFrame, pieces: int) -> DataFrame:
    """The same answer for definitions too large for one task.

    A range partitioning cuts each log into consecutive pieces. Each piece is
    folded by itself; one summary row per piece then tells the next piece what
    its first epoch starts from.
    """
    # about half the limit each, so that uneven ranges stay below it
    placed = cut(log.repartitionByRange(2 * pieces, "definition_id", *ORDER).withColumn("piece", F.spark_partition_id()))
    local = _windowed(placed, ["definition_id", "piece"])
    left_in = F.col("epoch") + _is("reopen").cast("int")  # the epoch the action leaves behind
    per_epoch = local.groupBy("definition_id", "piece", left_in.alias("epoch")).agg(
        F.min_by(_verb(), F.when(_verb().isNotNull(), F.struct(*ORDER))).alias("verb")
    )
    summary = per_epoch.groupBy("definition_id", "piece").agg(
        F.max("epoch").alias("reopens"), F.max_by("verb", "epoch").alias("last_verb")
    )
    by_piece = Window.partitionBy("definition_id").orderBy("piece")
    era = summary.withColumn("era", F.sum((F.col("reopens") > 0).cast("int")).over(by_piece.rowsBetween(*UP_TO)))
    in_era = Window.partitionBy("definition_id", "era").orderBy("piece")
    after = era.withColumn("verb_after", F.first("last_verb", ignorenulls=True).over(in_era.rowsBetween(*UP_TO)))
    carried = after.select("definition_id", "piece", F.lag("verb_after").over(by_piece).alias("carried"))
    joined = local.join(carried, ["definition_id", "piece"])
    return joined.withColumn(
        "verb_before", F.when(F.col("epoch") == 0, F.coalesce("carried", "verb_before")).otherwise(F.col("verb_before"))
    ).drop("piece", "carried")


def states(log: DataFrame, hot_actions: int = HOT_ACTIONS) -> DataFrame:
    """The log with `state_before` every action and its `outcome`: applied, noop or invalid.

    The sizes of the groups are looked at first; only definitions above
    `hot_actions` take the route that splits them.
    """
    sizes = log.groupBy("definition_id").agg(F.count("*").alias("n")).where(F.col("n") > hot_actions)
    hot_rows = sizes.agg(F.sum("n")).first()[0]
    if hot_rows is None:
        return _ended_in_window(_windowed(log, ["definition_id"]))
    # at most total rows / hot_actions names
    hot = cut(sizes.select("definition_id"))
    quiet = _ended_in_window(_windowed(log.join(hot, "definition_id", "left_anti"), ["definition_id"]))
    spread = _spread(log.join(hot, "definition_id", "left_semi"), math.ceil(hot_rows / hot_actions))
    return quiet.unionByName(_ended_by_join(spread))


def _effective_supersede() -> Column:
    """Supersede counts only on an approved definition; the first such action ends the history."""
    return F.when(_is("supersede") & (_reached(F.col("verb_before")) == "approved"), F.struct(*ORDER))


def _ended_in_window(walked: DataFrame) -> DataFrame:
    whole = Window.partitionBy("definition_id")
    return _with_outcome(walked.withColumn("ended", F.min(_effective_supersede()).over(whole)))


def _ended_by_join(walked: DataFrame) -> DataFrame:
    walked = cut(walked)
    ends = walked.groupBy("definition_id").agg(F.min(_effective_supersede()).alias("ended"))
    return _with_outcome(walked.join(ends, "definition_id"))


def _with_outcome(walked: DataFrame) -> DataFrame:
    over = F.coalesce(F.struct(*ORDER) > F.col("ended"), F.lit(False))
    before = F.when(over, "superseded").otherwise(_reached(F.col("verb_before")))
    return walked.withColumn("state_before", before).withColumn("outcome", outcome()).drop(
        "ended", "epoch", "verb_before"
    )


def outcome() -> Column:
    before = F.col("state_before")
    applied = (
        (_is("approve") & (before == "proposed"))
        | (_is("reject") & (before == "proposed"))
        | (_is("edit") & (before == "proposed"))
        | (_is("reopen") & (before != "superseded"))
        | (_is("supersede") & (before == "approved"))
    )
    noop = (_is("approve") & (before == "approved")) | (_is("reject") & (before == "rejected"))
    return F.when(applied, "applied").when(noop, "noop").otherwise("invalid")


def invalid_reason() -> Column:
    return F.when(
        F.col("outcome") == "invalid",
        F.concat(F.lit("cannot "), F.col("action"), F.lit(" a definition that is "), F.col("state_before")),
    )


def fold(walked: DataFrame) -> DataFrame:
    """One row per definition: status and the last applied decision of each kind.

    Reopening clears nothing, so an earlier approval stays on record. Plain
    grouped maxima, combined before the shuffle.
    """
    here = F.struct(*ORDER)

    def last(action: str, value: str) -> Column:
        hit = _is(action) & (F.col("outcome") == "applied")
        return F.max_by(F.col(value), F.when(hit, here))

    verbs = F.col("outcome").eqNullSafe("applied") & F.col("action").isin("approve", "reject", "reopen", "supersede")
    final = F.max_by("action", F.when(verbs, here))
    reached = (
        F.when(final == "approve", "approved").when(final == "reject", "rejected")
        .when(final == "supersede", "superseded").otherwise("proposed")
    )
    return walked.groupBy("definition_id").agg(
        reached.alias("status"),
        last("approve", "actor").alias("approved_by"),
        last("approve", "at").alias("approved_at"),
        last("reject", "actor").alias("rejected_by"),
        last("reject", "at").alias("rejected_at"),
        last("reject", "reason").alias("rejected_reason"),
        last("reopen", "at").alias("reopened_at"),
        F.count("*").alias("n_actions"),
    )


def edits(walked: DataFrame) -> DataFrame:
    """(definition_id, field, value): last value of each editable field over applied edits; NULL changes nothing."""
    applied = walked.where(_is("edit") & (F.col("outcome") == "applied"))
    pairs = applied.select("definition_id", *ORDER, F.explode("fields").alias("field", "value"))
    return (
        pairs.where(F.col("field").isin(EDITABLE_FIELDS) & F.col("value").isNotNull())
        .groupBy("definition_id", "field").agg(F.max_by("value", F.struct(*ORDER)).alias("value"))
    )


def approval_history(walked: DataFrame, name: str = "definition_id") -> DataFrame:
    """Every applied approval in time order per name, the newest marked."""
    approvals = walked.where(_is("approve") & (F.col("outcome") == "applied"))
    newest = approvals.groupBy(name).agg(F.max(F.struct(*ORDER)).alias("newest"))
    marked = approvals.join(newest, name)
    return marked.select(
        name, *ORDER, F.col("actor").alias("approved_by"), (F.struct(*ORDER) == F.col("newest")).alias("is_current")
    )


def resolve_names(definitions: DataFrame) -> DataFrame:
    """Name to its newest approved version, ties by id; every version stays addressable by id."""
    approved = definitions.where("status = 'approved'")
    order = Window.partitionBy("name").orderBy(F.desc("approved_at"), "id")
    return approved.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


# Chains of at most so many versions are followed by doubling alone; of longer ones, one version in MARK_ONE_IN is a mark.
FEW_VERSIONS = 100_000
MARK_ONE_IN = 4


def supersession_roots(definitions: DataFrame) -> DataFrame:
    """(id, root_id, depth): the first version behind each definition, by pointer doubling over supersedes_id.

    Doubling over all versions would shuffle each of them once a round. So every version is followed to the next mark only,
    which takes few rounds and soon leaves few versions; the marks, a quarter, are then followed in the same way, and
    what they find is handed to the others. All rounds together shuffle a few times the input, however long a chain is.
    Ids that repeat are followed by doubling alone. What still moves when as many versions as there are have been
    passed is a cycle.
    """
    hops = definitions.select(
        "id", F.col("supersedes_id").alias("next"), F.when(F.col("supersedes_id").isNotNull(), 1).otherwise(0).alias("depth")
    )
    known = definitions.select(F.col("id").alias("next"))
    hops = hops.join(known.withColumn("exists", F.lit(True)), "next", "left").select(
        "id", F.when(F.col("exists"), F.col("next")).alias("next"), F.when(F.col("exists"), F.col("depth")).otherwise(0).alias("depth")
    )
    paths = cut(hops.select("id", F.coalesce("next", "id").alias("root_id"), "depth"))
    repeated = paths.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        return _doubled(paths)
    # a first version without an id is its own root, which nothing can name
    ended = paths.where("root_id is not null").withColumn("ended", F.col("depth") == 0)
    return _followed(ended, 0).select("id", "root_id", "depth")


def _doubled(paths: DataFrame) -> DataFrame:
    """Every round doubles the distance of all; lineage is cut every round."""
    for _ in range(paths.count().bit_length() + 1):
        ahead = paths.select(F.col("id").alias("root_id"), F.col("root_id").alias("far"), F.col("depth").alias("more"))
        stepped = cut(paths.join(ahead, "root_id").select("id", F.col("far").alias("root_id"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        paths = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return paths
    raise ValueError("supersession chains contain a cycle")


def _followed(paths: DataFrame, level: int) -> DataFrame:
    """id, root_id, depth, ended: every version at its root, where it has ended. Ids are distinct; pointers lead to ids that are there."""
    n = paths.count()
    marked = n > FEW_VERSIONS

    def is_mark(version: str) -> Column:
        return F.pmod(F.xxhash64(F.col(version).cast("string"), F.lit(level)), F.lit(MARK_ONE_IN)) == 0 if marked else F.lit(False)

    moving = ~F.col("ended") & ~is_mark("root_id")
    there, rest, left = paths.where(~moving), paths.where(moving), n
    for _ in range(n.bit_length() + 1):
        left = rest.count()
        if not left:
            break
        # versions grow with the tables and are merged; a few that are left are sent to the others
        few = rest.hint("broadcast" if left <= FEW_VERSIONS and n > FEW_VERSIONS else "merge")
        ahead = there.union(rest).where(~is_mark("id")).select(
            F.col("id").alias("root_id"), F.col("root_id").alias("far"), F.col("depth").alias("more"), F.col("ended").alias("over"))
        stepped = cut(few.join(ahead, "root_id").select(
            "id", F.col("far").alias("root_id"), (F.col("depth") + F.col("more")).alias("depth"), F.col("over").alias("ended")))
        there, rest = there.union(stepped.where(~moving)), stepped.where(moving)
    if left:
        raise ValueError("supersession chains contain a cycle")
    if not marked:
        return there
    solved = cut(_followed(cut(there.where(is_mark("id"))), level + 1))
    others = there.where(~is_mark("id") | F.col("id").isNull())
    ahead = solved.select(F.col("id").alias("root_id"), F.col("root_id").alias("far"), F.col("depth").alias("more"))
    handed = others.where(~F.col("ended")).join(ahead.hint("merge"), "root_id").select(
        "id", F.col("far").alias("root_id"), (F.col("depth") + F.col("more")).alias("depth"), F.lit(True).alias("ended"))
    return solved.union(others.where("ended")).union(handed)


def edited_fields(definitions: DataFrame, fields: list[str] = EDITABLE_FIELDS) -> DataFrame:
    """(id, parent_id, field, original, current) for every field that differs from the parent proposal."""
    parent = definitions.select(F.col("id").alias("parent_id"), F.struct(*fields).alias("before"))
    child = definitions.where("parent_id is not null").select("id", "parent_id", F.struct(*fields).alias("after"))
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"before.{f}").cast("string").alias("original"),
                F.col(f"after.{f}").cast("string").alias("current"),
            )
            for f in fields
        ]
    )
    return (
        child.join(parent, "parent_id").select("id", "parent_id", F.inline(pairs))
        .where(~F.col("original").eqNullSafe(F.col("current")))
    )
