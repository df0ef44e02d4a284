"""Repair of the structure of conversations by iterative-deepening A*.

A conversation's turns are to give role initials `(s?(ua)+)?`. Each turn is kept, given another role or deleted, and turns
may be inserted; the cheapest edits are sought and, among these, the ones whose initials in order (D, I, K, R) come first
in ASCII. The search goes depth first in that order under a bound on the cost, which rises to the least cost that a
search stopped at. A table holds, for each turn and state of the roles, the largest remaining cost that has failed. The
first accepting path is the answer. The estimate of what the rest costs at least is that of a rest that may end with any
role; a right end costs two inserted turns at most, so the bound rises a few times only and the work grows with the
number of turns.

One shuffle brings a conversation's turns together, sorted: all turns without their texts first, then all with them. So
a task decides on marks of a few bytes a turn and then lets the texts pass one by one; it never holds a conversation's
texts. The answer for one conversation, in which every turn can depend on all others, is one task's work by nature.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.ngrams import text_slices

# Worker code travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs; keeping is free
SOUND, BLANK_TURN, DUPLICATE_TURN, TRUNCATED_TURN = range(4)
WHITE = " \t\n\x0b\f\r"
ENDS = ".!?"
LARGEST = 2**63 - 1

START, SYSTEM, USER, ASSISTANT = range(4)  # what the turns so far end with
AFTER = (USER, USER, ASSISTANT, USER)  # where a turn that is inserted or given a role leads
ROLE = ("user", "user", "assistant", "user")
LEGAL_PAIRS = ("su", "ua", "au")
MARK = {letter: ord(letter) for letter in "DIKR"}


def kept(state: int, initial: str) -> int:
    """The state after a kept turn, or -1. A role without letters adds no initial and changes nothing."""
    if initial == "u":
        return USER if state != USER else -1
    if initial == "a":
        return ASSISTANT if state == USER else -1
    if initial == "s":
        return SYSTEM if state == START else -1
    return state if not initial else -1


def least_rest(faults: bytes, initials: list[str]) -> array:
    """At 4 * i + state: what the turns from i on cost at least, if they may end with any role."""
    n = len(faults)
    out = array("q", bytes(32 * (n + 1)))
    for i in range(n - 1, -1, -1):
        fault, later = faults[i], out[4 * i + 4 : 4 * i + 8]
        extra = TRUNCATED if fault == TRUNCATED_TURN else 0
        alone = []
        for state in range(4):
            cost = DELETE + later[state]
            if fault != BLANK_TURN and fault != DUPLICATE_TURN:
                to = kept(state, initials[i])
                if to >= 0:
                    cost = min(cost, extra + later[to])
                cost = min(cost, REROLE + extra + later[AFTER[state]])
            alone.append(cost)
        for state in range(4):
            one = AFTER[state]
            out[4 * i + state] = min(alone[state], INSERT + alone[one], 2 * INSERT + alone[AFTER[one]])
    return out


def cheapest_edits(faults: bytes, initials: list[str]) -> tuple[int, bytearray]:
    """The least cost and the initials of the edits."""
    n, rest = len(faults), least_rest(faults, initials)
    bound = rest[START]
    while True:
        failed, beyond = array("q", b"\xff" * (32 * (n + 1))), LARGEST  # -1: nothing has failed
        # one entry per step of the path: turn, state, what may still be spent, next edit to try
        at, states, left, tries, path = array("q", [0]), bytearray([START]), array("q", [bound]), bytearray([0]), bytearray()
        while at:
            i, state, room, edit = at[-1], states[-1], left[-1], tries[-1]
            if not edit and i == n and state in (START, ASSISTANT):
                return bound, path
            fault = faults[i] if i < n else SOUND
            extra = TRUNCATED if fault == TRUNCATED_TURN else 0
            bound_to_go = i < n and fault in (BLANK_TURN, DUPLICATE_TURN)
            to = -1
            while to < 0 and edit < 4:
                if edit == 0 and i < n:
                    to, cost, letter, step = state, DELETE, MARK["D"], 1
                elif edit == 1:
                    to, cost, letter, step = AFTER[state], INSERT, MARK["I"], 0
                elif edit == 2 and i < n and not bound_to_go:
                    to, cost, letter, step = kept(state, initials[i]), extra, MARK["K"], 1
                elif edit == 3 and i < n and not bound_to_go:
                    to, cost, letter, step = AFTER[state], REROLE + extra, MARK["R"], 1
                edit += 1
                if to >= 0:
                    spare = room - cost - rest[4 * (i + step) + to]
                    if spare < 0:
                        beyond, to = min(beyond, -spare), -1
                    elif failed[4 * (i + step) + to] >= room - cost:
                        to = -1
            tries[-1] = edit
            if to >= 0:
                at.append(i + step), states.append(to), left.append(room - cost), tries.append(0), path.append(letter)
            else:
                failed[4 * i + state] = max(failed[4 * i + state], room)
                at.pop(), states.pop(), left.pop(), tries.pop()
                if path:
                    path.pop()
        bound += beyond


class Conversation:
    """Marks of one conversation's turns in order, and the edits once they are all there."""

    def __init__(self, conv_id):
        self.conv_id, self.faults, self.initials, self.seen = conv_id, bytearray(), [], set()
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0
        self.edits, self.cost = None, 0

    def add(self, turn, role: str, content: bytes, fault: int) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += turn != self.last
            self.last = turn
        if fault != BLANK_TURN and content in self.seen:
            fault = DUPLICATE_TURN
        self.seen.add(content)
        initial = sys.intern(role[:1])
        if self.initials:
            self.illegal += self.initials[-1] + initial not in LEGAL_PAIRS
        self.initials.append(initial)
        self.faults.append(fault)

    def search(self) -> None:
        self.seen = None
        self.cost, self.edits = cheapest_edits(bytes(self.faults), self.initials)
        self.next, self.row, self.placed, self.state = 0, 0, 0, START

    def _inserted(self) -> Iterator[str]:
        while self.next < len(self.edits) and self.edits[self.next] == MARK["I"]:
            yield ROLE[self.state]
            self.state = AFTER[self.state]
            self.next += 1

    def repaired(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of what stands for the next turn, behind turns inserted before it."""
        for new in self._inserted():
            yield "I", new, ""
        edit = self.edits[self.next]
        self.next += 1
        if edit == MARK["K"]:
            self.state = kept(self.state, self.initials[self.row])
            yield "K", role, text
        elif edit == MARK["R"]:
            role = ROLE[self.state]
            self.state = AFTER[self.state]
            yield "R", role, text
        self.row += 1

    def ending(self) -> Iterator[tuple[str, str, str]]:
        for new in self._inserted():
            yield "I", new, ""


def marked(turns: DataFrame) -> DataFrame:
    """Each turn twice, without its text and with it, together and in order by conversation. A null role or text is one space."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    shown = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(shown == "", BLANK_TURN).when(~F.right(shown, F.lit(1)).isin(*ENDS), TRUNCATED_TURN).otherwise(SOUND)
    rows = turns.withColumns({"role": role, "text": text})
    twice = rows.select(
        "conv_id", "turn", "role", "gone", fault.alias("fault"),
        F.unhex(F.sha2(F.concat_ws("\0", "role", "text"), 256)).substr(1, 16).alias("content"), "text",
        F.explode(F.when(F.col("gone"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("again"))
    return twice.withColumn("text", F.when(F.col("again") == 1, F.col("text"))).repartition("conv_id").sortWithinPartitions(
        "conv_id", "again", F.asc_nulls_first("turn"), "role", "content")


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, its turn or None): each conversation with every turn that has a text, then alone at its end."""
    now = None

    def ended() -> tuple:
        if now.edits is None:
            now.search()
        return now, None

    for batch in batches:
        for part in text_slices(batch, "text"):
            columns = [part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "gone", "fault", "content", "text", "again")]
            for conv_id, turn, role, gone, fault, content, text, again in zip(*columns):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        yield ended()
                    now = Conversation(conv_id)
                if again:
                    if now.edits is None:
                        now.search()
                    yield now, (role, text)
                elif not gone:
                    now.add(turn, role, content, fault)
    if now is not None:
        yield ended()


def _narrow(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, gone: Column | None) -> DataFrame:
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    return turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"),
        F.col(text).alias("text"), gone.alias("gone"))


def repair(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I), role, text.

    Turns stand in order of `turn`, nulls first, then role, then a digest of role and text. A null role or text is one
    space, so a null text is blank and its turn goes; a null conv_id is a conversation of its own. Repeated turns are
    duplicates. Turns without visible characters and repetitions are always deleted, so a conversation may end up
    without rows. An empty table gives an empty result; other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        schema = pa.schema([
            ("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for conversation, row in conversations_of(batches):
            for edit, new_role, new_text in conversation.repaired(*row) if row else conversation.ending():
                rows.append((conversation.conv_id, conversation.placed, edit, new_role, new_text))
                conversation.placed += 1
                size += len(new_text)
            if len(rows) >= 5000 or size > 1 << 20:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    narrow = _narrow(turns, conv_id, turn, role, text, None)
    return marked(narrow).mapInArrow(
        run, "conv_id bigint, position bigint, edit string, role string, text string")


SUMMARY = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def summary(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None,
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The digest is that of the repaired `role:text`, one a line. Rows that `gone` marks are no turns, but their
    conversations are reported; one that has no turns has zeros, an empty audit and the digest of the empty string.
    Nulls, ties, repeated rows, empty tables and other columns are treated as in `repair`.
    """
    names = [column.split()[0] for column in SUMMARY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, digest, first = [], hashlib.sha256(), True
        schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)

        for conversation, row in conversations_of(batches):
            for _, new_role, new_text in conversation.repaired(*row) if row else conversation.ending():
                digest.update(("" if first else "\n").encode() + f"{new_role}:{new_text}".encode())
                first = False
            if row is None:
                c = conversation
                gaps = 0 if c.low is None else min(c.high - c.low + 1 - c.turns, LARGEST)
                faults = [c.faults.count(f) for f in (BLANK_TURN, DUPLICATE_TURN, TRUNCATED_TURN)]
                done.append((c.conv_id, gaps, *faults, c.illegal, c.cost, c.edits.decode(), digest.hexdigest()))
                digest, first = hashlib.sha256(), True
                if len(done) >= 2000:
                    yield flush()
                    done = []
        if done:
            yield flush()

    narrow = _narrow(turns, conv_id, turn, role, text, gone)
    return marked(narrow).mapInArrow(run, SUMMARY)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: turns damaged by the CRC-32 of `conv_id:turn`, a null written as one space.

    Of the remainder by 20: 0 drops the turn (it stays as a row with `gone`), 1 empties its text, 2 removes its full
    stops, exclamation and question marks, 3 repeats it, 4 gives it the role user.
    """
    def shown(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    h = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(h == 1, F.lit("")).when(h == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    copies = F.when(h == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    return turns.select(
        "conv_id", "turn", F.when(h == 4, F.lit("user")).otherwise(shown("role")).alias("role"), text.alias("text"),
        (h == 0).alias("gone"), F.explode(copies).alias("_copy")).drop("_copy")
