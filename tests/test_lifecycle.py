import datetime
import itertools
import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from assayer.operators import lifecycle
from assayer.streaming import decisions

ACTIONS = ["approve", "reject", "edit", "reopen", "supersede"]
LOG = "definition_id string, at timestamp_ntz, seq bigint, action string, actor string, reason string, fields map<string,string>"
START = datetime.datetime(2024, 1, 1)


def walk(actions):
    """Step by step: (state before, outcome) per action and the final record."""
    status, record, steps = "proposed", dict.fromkeys(["approved_by", "approved_at", "rejected_by", "rejected_at", "rejected_reason", "reopened_at"]), []
    for at, action, actor, reason in actions:
        before, outcome = status, "invalid"
        if action in ("approve", "reject"):
            done = {"approve": "approved", "reject": "rejected"}[action]
            if status == "proposed":
                status, outcome = done, "applied"
                record[f"{done}_by"], record[f"{done}_at"] = actor, at
                if action == "reject":
                    record["rejected_reason"] = reason
            elif status == done:
                outcome = "noop"
        elif action == "edit" and status == "proposed":
            outcome = "applied"
        elif action == "reopen" and status != "superseded":
            status, outcome, record["reopened_at"] = "proposed", "applied", at
        elif action == "supersede" and status == "approved":
            status, outcome = "superseded", "applied"
        steps.append((before, outcome))
    return steps, {"status": status, **record}


def make_log(sequences):
    """Several actions share a time, so that `seq` decides."""
    rows, logs, seq = [], {}, 0
    for n, sequence in enumerate(sequences):
        for i, action in enumerate(sequence):
            at = START + datetime.timedelta(hours=i // 2)
            reason = None if seq % 3 else f"r{seq}"
            rows.append((f"d{n}", at, seq, action, f"u{seq % 7}", reason, {"name": f"n{seq}" if seq % 2 else None, "status": "hacked"}))
            logs.setdefault(f"d{n}", []).append((at, action, f"u{seq % 7}", reason))
            seq += 1
    random.Random(5).shuffle(rows)
    return rows, logs


def check(spark, sequences, hot):
    rows, logs = make_log(sequences)
    walked = lifecycle.states(spark.createDataFrame(rows, LOG), hot_actions=hot)
    got = {}
    for r in walked.orderBy("seq").collect():
        got.setdefault(r.definition_id, []).append((r.state_before, r.outcome))
    folded = {r.definition_id: r.asDict() for r in lifecycle.fold(walked).collect()}
    for name, log in logs.items():
        steps, record = walk(log)
        assert got[name] == steps, log
        assert {k: folded[name][k] for k in record} == record, log


def test_every_sequence_up_to_length_five(spark):
    check(spark, [s for n in range(1, 6) for s in itertools.product(ACTIONS, repeat=n)], lifecycle.HOT_ACTIONS)


def test_hot_definitions_are_split_with_the_same_result(spark):
    rng = random.Random(11)
    long = [[rng.choice(ACTIONS[:4] if rng.random() < 0.97 else ACTIONS) for _ in range(n)] for n in (400, 300, 120, 5, 3)]
    quiet = [["edit"] * 200, ["approve"] + ["reopen", "edit", "edit"] * 60, ["reject"] * 150, ["approve"] * 90 + ["supersede"] + ["reopen"] * 60]
    check(spark, long + quiet, 50)


def test_edits_keep_the_last_value_and_ignore_foreign_fields(spark):
    fields = [{"name": "a", "status": "approved"}, {"name": None, "confidence": "low"}, {"name": "b"}, {"name": "late"}]
    actions = ["edit", "edit", "edit", "approve", "edit"]
    rows = [("d", START, i, a, "u", None, ([*fields[:3], {}, fields[3]])[i]) for i, a in enumerate(actions)]
    got = lifecycle.edits(lifecycle.states(spark.createDataFrame(rows, LOG))).collect()
    assert {r.field: r.value for r in got} == {"name": "b", "confidence": "low"}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows, logs = make_log([[rng.choice(ACTIONS) for _ in range(rng.randint(1, 12))] for _ in range(40)])
    rows.sort(key=lambda r: (r[1], r[2]))
    whole = spark.createDataFrame(rows, LOG)
    for part, (low, high) in enumerate([(0, 2), (2, 4), (4, 99)]):  # hours; arrival in time order
        bounds = [START + datetime.timedelta(hours=h) for h in (low, high)]
        whole.where((whole.at >= bounds[0]) & (whole.at < bounds[1])).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log")
        decisions.run_available(decisions.fold_stream(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/ckpt")
    got = decisions.newest_states(spark.read.parquet(f"file://{tmp_path}/out").drop("trigger"))
    want = lifecycle.fold(lifecycle.states(whole))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


DEFINITIONS = "id string, name string, display_name string, description string, rationale string, confidence string, status string, approved_at int, supersedes_id string, parent_id string"


def test_names_resolve_to_the_newest_approved_version(spark):
    rows = [("1", "arr", "", "", "", "low", "superseded", 9, None, None), ("2", "arr", "", "", "", "low", "approved", 5, "1", None),
            ("3", "arr", "", "", "", "low", "approved", 5, None, None), ("4", "ltv", "", "", "", "low", "proposed", None, None, None)]
    got = lifecycle.resolve_names(spark.createDataFrame(rows, DEFINITIONS)).collect()
    assert [(r.name, r.id) for r in got] == [("arr", "2")]


def test_chains_and_edit_diff(spark):
    chain = [(str(i), "n", "", "", "", "low", "approved", i, str(i - 1) if i else None, None) for i in range(50)]
    got = {r.id: (r.root_id, r.depth) for r in lifecycle.supersession_roots(spark.createDataFrame(chain, DEFINITIONS)).collect()}
    assert got == {str(i): ("0", i) for i in range(50)}
    rows = [("p", "a", "A", "d", None, "low", "proposed", None, None, None), ("c", "a", "B", "d", "why", "high", "proposed", None, None, "p")]
    diff = lifecycle.edited_fields(spark.createDataFrame(rows, DEFINITIONS)).collect()
    assert {(r.field, r.original, r.current) for r in diff} == {("display_name", "A", "B"), ("rationale", None, "why"), ("confidence", "low", "high")}


@pytest.mark.parametrize("few", [0, 7, 10_000])
def test_chains_over_marks_equal_a_walk(spark, monkeypatch, few):
    """Branching chains of all lengths, first versions, versions whose predecessor is gone or that have no id."""
    monkeypatch.setattr(lifecycle, "FEW_VERSIONS", max(few, 2))
    rng = random.Random(few)
    before = {i: rng.choice([i - 1, i - 1, i - 1, i - 7, None, 5000 + i]) for i in range(1, 400)} | {0: None}
    rows = [(str(i), *"ndurls", 0, None if j is None else str(j), None) for i, j in before.items()] + [(None, *"ndurls", 0, "20", None), (None, *"ndurls", 0, None, None)]
    got = {(r.id, r.root_id, r.depth) for r in lifecycle.supersession_roots(spark.createDataFrame(rows, DEFINITIONS)).collect()}

    def walk(i):
        depth = 0
        while before.get(i) in before:
            i, depth = before[i], depth + 1
        return str(i), depth

    of_20 = walk(20)
    assert got == {(str(i), *walk(i)) for i in before} | {(None, of_20[0], of_20[1] + 1)}


def test_rounds_of_chains_grow_shorter(spark, monkeypatch):
    """What all rounds write stays a few times the input, on one chain of many versions too."""
    monkeypatch.setattr(lifecycle, "FEW_VERSIONS", 20)
    rows, kept = [], lifecycle.cut

    def watched(df):
        done = kept(df)
        rows.append(done.count())
        return done

    monkeypatch.setattr(lifecycle, "cut", watched)
    n = 3000
    chain = [(str(i), *"ndurls", 0, str(i - 1) if i else None, None) for i in range(n)]
    assert lifecycle.supersession_roots(spark.createDataFrame(chain, DEFINITIONS)).agg(F.max("depth")).first()[0] == n - 1
    assert sum(rows) < 8 * n


def test_repeated_versions_stay_as_they_were(spark):
    rows = [(str(i), *"ndurls", 0, str(i - 1) if i else None, None) for i in range(3)] * 2
    assert {r.id: (r.root_id, r.depth) for r in lifecycle.supersession_roots(spark.createDataFrame(rows, DEFINITIONS)).collect()} == {str(i): ("0", i) for i in range(3)}


def test_cycles_over_marks_are_reported(spark, monkeypatch):
    monkeypatch.setattr(lifecycle, "FEW_VERSIONS", 2)
    rows = [(str(i), *"ndurls", 0, str((i + 1) % 40), None) for i in range(40)]
    with pytest.raises(ValueError):
        lifecycle.supersession_roots(spark.createDataFrame(rows, DEFINITIONS))


def test_cycles_are_reported(spark):
    rows = [("a", "n", "", "", "", "low", "approved", 1, "b", None), ("b", "n", "", "", "", "low", "approved", 1, "a", None)]
    with pytest.raises(ValueError):
        lifecycle.supersession_roots(spark.createDataFrame(rows, DEFINITIONS))


def test_the_state_handler_needs_no_package_on_the_workers(tmp_path):
    (tmp_path / "handler").write_bytes(cloudpickle.dumps(decisions._step))
    code = "import pickle, sys; pickle.load(open('handler', 'rb')); sys.exit('assayer' in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
