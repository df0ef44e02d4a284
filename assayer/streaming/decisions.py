"""Incremental fold of the decision log with Structured Streaming."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState

# The state handler travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = (
    "definition_id string, status string, approved_by string, approved_at timestamp_ntz, rejected_by string, "
    "rejected_at timestamp_ntz, rejected_reason string, reopened_at timestamp_ntz, n_actions bigint"
)
STATE = OUTPUT.split(", ", 1)[1]
FIELDS = [f.split()[0] for f in STATE.split(", ")]


def apply_action(state: dict, action: str, actor, at, reason) -> None:
    """One step of the review life cycle, in place."""
    status = state["status"]
    if action == "approve" and status == "proposed":
        state.update(status="approved", approved_by=actor, approved_at=at)
    elif action == "reject" and status == "proposed":
        state.update(status="rejected", rejected_by=actor, rejected_at=at, rejected_reason=reason)
    elif action == "reopen" and status != "superseded":
        state.update(status="proposed", reopened_at=at)
    elif action == "supersede" and status == "approved":
        state.update(status="superseded")


def _missing_to_none(value):
    return None if pd.isna(value) else value


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    current = dict(zip(FIELDS, state.get)) if state.exists else dict.fromkeys(FIELDS) | {"status": "proposed", "n_actions": 0}
    # a trigger reads a bounded number of files, so this is a bounded share of one log
    actions = pd.concat(list(batches)).sort_values(["at", "seq"])
    for row in actions.itertuples(index=False):
        apply_action(current, row.action, row.actor, row.at, _missing_to_none(row.reason))
    current["n_actions"] += len(actions)
    values = tuple(_missing_to_none(current[f]) for f in FIELDS)
    state.update(values)
    yield pd.DataFrame([(key[0], *values)], columns=["definition_id", *FIELDS])


def fold_stream(log: DataFrame) -> DataFrame:
    """Changed definitions per trigger, in update mode.

    log: definition_id STRING, at TIMESTAMP_NTZ, seq, action, actor, reason. Actions of
    one trigger are ordered here; one that arrives in a later trigger than its
    successors would change history, for which the batch fold is the reference.
    """
    columns = log.select("definition_id", "at", "seq", "action", "actor", "reason")
    return columns.groupBy("definition_id").applyInPandasWithState(_step, OUTPUT, STATE, "update", "NoTimeout")


def run_available(changes: DataFrame, output: str, checkpoint: str) -> None:
    """Process everything that has arrived and stop. Each trigger's rows carry its number.

    A repeated trigger overwrites its own folder, so a restart leaves no duplicates.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("trigger_number", F.lit(number)).write.mode("overwrite").parquet(f"{output}/trigger={number}")

    query = (
        changes.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def newest_states(changes: DataFrame) -> DataFrame:
    """Last written state per definition."""
    state = [c for c in changes.columns if c not in ("definition_id", "trigger_number", "trigger")]
    return changes.groupBy("definition_id").agg(
        F.max_by(F.struct(*state), "trigger_number").alias("s")
    ).select("definition_id", "s.*")
