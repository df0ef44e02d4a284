"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer writes every word of a clause as a symbol with a weight: insult, threat, target, negation, reported
speech, or other. A clause machine reads the symbols; its states remember whether a negation stands close before,
whether the clause reports what somebody else says, and whether somebody is addressed. What an insult or a threat counts
depends on that state, so matched clauses are scored and not isolated words: "you are an idiot" counts more than
"idiot", and "he said you are no idiot" far less.

Insults beyond a short list are learnt, as words and as word beginnings, from a bounded sample of labelled rows; a
logistic curve over a text's clause scores is fitted on other labelled rows, again a bounded sample. Every text is then
read as a whole.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from assayer.llm.ngrams import text_slices
from assayer.llm.quality import fold
from assayer.session import cut

# Worker code travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = {1: 4000, 0: 8000}  # most labelled documents, on average, that the insults are learnt from
FIT_SAMPLE = 20_000  # most labelled documents, on average, that the curve is fitted on
LEXICON = 600  # most learnt entries
BEGINNINGS = range(4, 10)  # lengths of word beginnings that may become entries
LEAST_ODDS = 1.5
THRESHOLD = 0.5

INSULTS = (
    "idiot idiots idiotic moron morons stupid scum loser losers trash worthless pathetic disgusting clown clowns dumb dumbass "
    "imbecile vermin parasite bastard bitch asshole scumbag retard filth garbage pig pigs freak jerk fool ugly"
).split()
THREATS = "kill killing hurt destroy burn shoot stab beat smash hang hunt murder crush die suffer strangle".split()
TARGETS = "you your yours yourself u ur he she him her his they them their those these people everyone du ihr sie dich euch tu vous te vos usted ustedes ellos".split()
NEGATIONS = "not no never isn't aren't wasn't weren't don't doesn't didn't won't cannot can't without nobody none nicht kein keine nie pas jamais nunca".split()
REPORTS = "said says say saying told tells claimed claims wrote writes quoted quote called reported reports according allegedly sagte dit dijo".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = {w: s for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}

LISTED = 3.0  # weight of a listed insult that was not learnt
THREATENED = 2.5  # weight of a threat against somebody
NEGATED, REPORTED, ADDRESSED, IDLE_THREAT = 0.3, 0.5, 1.3, 0.1  # factors
REACH = 3  # words over which a negation is felt

CLAUSE_END = re.compile(r"[.!?;:\n|\"]")
WORD = re.compile(r"\w+(?:'\w+)?")
FEATURES = ["total", "highest", "hits", "density", "forms", "length"]


def machine() -> dict[tuple[tuple[int, bool, bool], int], tuple[tuple[int, bool, bool], float]]:
    """(state, symbol) -> (next state, factor). A state is (words since a negation, reported, addressed)."""
    table = {}
    for away in range(REACH + 1):
        for reported in (False, True):
            for addressed in (False, True):
                factor = (NEGATED if away < REACH else 1.0) * (REPORTED if reported else 1.0)
                after = min(away + 1, REACH)
                state = (away, reported, addressed)
                table[state, OTHER] = ((after, reported, addressed), 0.0)
                table[state, TARGET] = ((after, reported, True), 0.0)
                table[state, NEGATION] = ((0, reported, addressed), 0.0)
                table[state, REPORT] = ((after, True, addressed), 0.0)
                table[state, INSULT] = ((after, reported, addressed), factor * (ADDRESSED if addressed else 1.0))
                table[state, THREAT] = ((after, reported, addressed), factor * (1.0 if addressed else IDLE_THREAT))
    return table


class Grammar:
    """Scores the clauses of a text that hold an entry of the lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        """Entries that end in * are word beginnings."""
        import ahocorasick

        self.exact = {w: LISTED for w in INSULTS} | {e: w for e, w in lexicon.items() if not e.endswith("*")}
        self.begins = {e[:-1]: w for e, w in lexicon.items() if e.endswith("*")}
        self.lengths = sorted({len(b) for b in self.begins})
        self.machine = machine()
        self.finder = ahocorasick.Automaton()
        for entry in {*self.exact, *self.begins, *THREATS}:
            self.finder.add_word(entry, len(entry))
        self.finder.make_automaton()

    def symbol(self, word: str) -> tuple[int, float]:
        """The lexical transducer: the word's symbol and weight."""
        weight = self.exact.get(word, 0.0)
        for n in self.lengths:
            if n < len(word):
                weight = max(weight, self.begins.get(word[:n], 0.0))
        if weight:
            return INSULT, weight
        symbol = SYMBOLS.get(word, OTHER)
        return symbol, THREATENED if symbol == THREAT else 0.0

    def clause(self, words: list[str]) -> tuple[float, list[str]]:
        """The clause's score and the words that matched."""
        state, total, matched = (REACH, False, False), 0.0, []
        symbols = [self.symbol(w) for w in words]
        # somebody addressed behind the insult counts as well
        if any(s == TARGET for s, _ in symbols):
            state = (REACH, False, True)
        for word, (symbol, weight) in zip(words, symbols):
            state, factor = self.machine[state, symbol]
            if factor:
                total += factor * weight
                matched.append(word)
        return total, matched

    def clauses(self, text: str) -> Iterator[tuple[int, int, float, list[str]]]:
        """Matched clauses of a text in lower case: start, end, score, words. Every clause is read once."""
        done = 0
        for last, size in self.finder.iter(text):
            at = last + 1 - size
            if at < done or (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
                continue
            start = max([done, *(text.rfind(c, done, at) + 1 for c in ".!?;:\n|\"")])
            end = CLAUSE_END.search(text, last)
            done = end.end() if end else len(text)
            score, words = self.clause(WORD.findall(text, start, done))
            if words:
                yield start, done, score, words

    def features(self, text: str | None) -> list[float]:
        text = (text or "").lower()
        total = highest = 0.0
        matched: list[str] = []
        for _, _, score, words in self.clauses(text):
            total, highest = total + score, max(highest, score)
            matched += words
        n_words = text.count(" ") + 1
        return [math.log1p(total), min(highest, 20.0), math.log1p(len(matched)), total / math.sqrt(n_words),
                math.log1p(len(set(matched))), math.log1p(n_words)]


def learnt(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries and weights: log odds of toxic documents among those with the word or beginning."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                entries = set()
                for w in set(WORD.findall((text or "").lower())):
                    if len(w) <= 40:
                        entries.add(w)
                        entries.update(w[:n] + "*" for n in BEGINNINGS if n < len(w))
                seen[toxic].update(entries)
        # an entry that no toxic document of this task has may still be an entry of another task
        words = list(seen[0].keys() | seen[1].keys())
        for a in range(0, len(words), 20_000):
            some = words[a : a + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array([seen[1][w] for w in some], pa.int64()), pa.array([seen[0][w] for w in some], pa.int64())],
                names=["entry", "toxic", "clean"])

    counted = sample.mapInArrow(count, "entry string, toxic bigint, clean bigint").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p, q = (F.col("toxic") + 1) / F.lit(n_toxic + 2.0), (F.col("clean") + 1) / F.lit(n_clean + 2.0)
    odds = counted.withColumn("odds", F.log(p) - F.log(q))
    least = max(5.0, n_toxic / 200)
    best = odds.where((F.col("toxic") >= least) & (F.col("odds") >= LEAST_ODDS)).orderBy(
        (F.col("odds") * F.col("toxic")).desc(), "entry").limit(LEXICON)
    return {r["entry"]: float(r["odds"]) for r in best.collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic curve, the constant last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sampled(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """About `most` rows at most, chosen by a hash of the number."""
    n = rows.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    return rows if n <= most else rows.where(part < int(most / n * 1_000_000))


def score(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    Labels are learnt from rows whose fold is not 0; folds 1 to 3 give the lexicon, fold 4 the curve. Labels that are
    neither 0 nor 1 are left out. Without labels of both kinds a text scores 0.5 and more if it holds a clause that the
    listed words match, and 0 otherwise. Null counts as the empty text, which matches nothing. An empty table gives an
    empty result; other columns are not read.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    truth = cut(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & (fold(F.col("doc_id")) != 0)))
    parts = [sampled(truth.where((F.col("y") == y) & (fold(F.col("doc_id")) != 4)), most, 7) for y, most in SAMPLE.items()]
    chosen = cut(parts[0].unionByName(parts[1]))
    by_label = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    # at most the sample's size, two numbers a row
    sample = narrow.join(F.broadcast(chosen), "doc_id").select("text", "y")
    lexicon = learnt(sample, by_label.get(1, 0), by_label.get(0, 0)) if len(by_label) == 2 else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = None
        for batch in batches:
            for part in text_slices(batch, "text"):
                grammar = grammar or Grammar(lexicon)
                rows = np.array([grammar.features(t) for t in part.column("text").to_pylist()]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], names=["doc_id", *FEATURES])

    found = cut(narrow.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{f} double" for f in FEATURES)))
    fit = sampled(truth.where(fold(F.col("doc_id")) == 4), FIT_SAMPLE, 8)
    rows = found.join(fit, "doc_id").select(*FEATURES, "y").collect()  # the sample's size at most, a few numbers a row
    if len({r["y"] for r in rows}) == 2:
        weights = logistic(np.array([r[:-1] for r in rows], dtype=float), np.array([r[-1] for r in rows], dtype=float))
        value = F.lit(float(weights[-1]))
        for f, w in zip(FEATURES, weights):
            value = value + F.col(f) * F.lit(float(w))
        result = 1 / (1 + F.exp(-value))
    else:
        result = F.when(F.col("highest") > 0, 1 - 0.5 * F.exp(-F.col("highest"))).otherwise(0.0)
    return found.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.round(result, 9).alias("score"),
        (F.round(result, 9) >= threshold).cast("int").alias("predicted"))


def matched_clauses(docs: DataFrame, lexicon: dict[str, float] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, end, score and words of every matched clause; places count characters of the text in lower case."""
    lexicon = lexicon or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = None
        for batch in batches:
            grammar = grammar or Grammar(lexicon)
            rows = [
                {"doc_id": i, "start": s, "end": e, "score": w, "words": words}
                for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                for s, e, w, words in grammar.clauses((t or "").lower())]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                    [("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()),
                     ("words", pa.list_(pa.string()))]))

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, start bigint, end bigint, score double, words array<string>")
