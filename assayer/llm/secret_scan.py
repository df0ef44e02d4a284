"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

Candidates are values assigned to a name such as token or password, long runs of letters and digits, and the formats of
well-known providers. Each is described by its length, the transitions between its characters, how much of it a
dictionary covers, the path it comes from, and the words beside it. A random forest, trained on labelled findings,
scores every candidate.

Findings that somebody labelled can be given. Without them a bounded sample of candidates is labelled by rules that
are strict on both sides; candidates that no rule is sure of are left for the forest alone.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from assayer.llm.ngrams import text_slices
from assayer.session import cut

# Worker code travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABELLED = 20_000  # most findings of either label, on average, that the forest is trained on
DICTIONARY_SHARE = 2_000  # a word of the dictionary occurs in one of so many documents at least
TREES, DEPTH, SEED = 30, 8, 8
THRESHOLD = 0.5
AROUND = 60  # characters of context on either side

NAMES = r"(?:[A-Za-z0-9]+[_.-])*(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|credential|bearer)s?(?:[_.-][A-Za-z0-9]+)*"
# Values have no upper length; possessive repeats give nothing back, so a long value is read once.
CANDIDATE = re.compile(
    rf"""(?P<assigned>(?<![A-Za-z0-9_.-]){NAMES}["']?\s{{0,3}}(?:=>|:=|=|:)\s{{0,3}}["']?(?P<value>[A-Za-z0-9+/_=.~!@#$%^&*-]{{8,}}+))"""
    r"|(?P<known>(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|sk_live_[A-Za-z0-9]{16,64}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9]))"
    r"|(?P<run>(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+)",
    re.IGNORECASE,
)
SECRET_WORD = re.compile(r"(?i)\b(?:token|secret|passw|pwd|key|auth|credential|bearer|login)")
DUMMY_WORD = re.compile(r"(?i)\b(?:example|sample|test|dummy|placeholder|changeme|xxx|your|fake|todo)")
HASH_WORD = re.compile(r"(?i)\b(?:md5|sha1|sha256|commit|checksum|digest|hash|uuid|etag|revision|build)")
TEST_PATH = re.compile(r"(?i)(?:test|spec|fixture|example|sample|doc|readme)")
WORD = re.compile(r"[a-z]{3,}")

FEATURES = [
    "length", "entropy", "class_changes", "letter_pairs", "digits", "upper", "hex", "distinct", "dictionary", "assigned",
    "known", "quoted", "secret_near", "dummy_near", "hash_near", "test_path", "path_depth", "words_near",
]


def character_class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def coverage(value: str, dictionary: frozenset[str]) -> float:
    """Share of the characters that words of the dictionary cover, longest first from the left."""
    low, at, covered = value.lower(), 0, 0
    while at < len(low):
        n = next((n for n in range(min(12, len(low) - at), 2, -1) if low[at : at + n] in dictionary), 0)
        covered, at = covered + n, at + (n or 1)
    return covered / len(low)


def described(value: str, before: str, after: str, path: str, assigned: bool, known: bool, dictionary: frozenset[str]) -> list[float]:
    n, counts = len(value), Counter(value)
    classes = [character_class(c) for c in value]
    near = before + " " + after
    return [
        math.log(n), -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(a != b for a, b in zip(classes, classes[1:])) / max(n - 1, 1),
        sum(a in "aeiou" and b in "bcdfghjklmnpqrstvwxyz" for a, b in zip(value.lower(), value.lower()[1:])) / max(n - 1, 1),
        classes.count(0) / n, classes.count(2) / n, sum(c in "0123456789abcdefABCDEF" for c in value) / n, len(counts) / n,
        coverage(value, dictionary), float(assigned), float(known), float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        float(bool(SECRET_WORD.search(near))), float(bool(DUMMY_WORD.search(near))), float(bool(HASH_WORD.search(near))),
        float(bool(TEST_PATH.search(path))), float(path.count("/")), sum(w in dictionary for w in WORD.findall(near.lower())) / 20,
    ]


def rule_label(features: dict[str, float]) -> int | None:
    """1 or 0 where the rules are sure."""
    if features["dummy_near"] or features["dictionary"] > 0.6:
        return 0
    random = features["entropy"] >= 3.0 and features["digits"] > 0.05
    if (features["known"] or features["assigned"]) and random and features["digits"] < 0.95:
        return 1
    if not features["secret_near"] and not features["assigned"] and not features["known"] and (features["digits"] >= 0.95 or features["hash_near"]):
        return 0
    return None


def dictionary_of(docs: DataFrame) -> list[str]:
    """Words that one of DICTIONARY_SHARE documents holds at least, counted over all documents.

    Their number is bounded by the distinct words of an average document times DICTIONARY_SHARE, whatever the table's
    size. Letters beside a digit are no word, or else the pieces of a secret would be its own dictionary in a small table.
    """
    words = docs.select(F.explode(F.expr(r"array_distinct(regexp_extract_all(lower(text), '(?<![a-z0-9])[a-z]{3,12}(?![a-z0-9])', 0))")).alias("word"))
    often = words.groupBy("word").count().where(F.col("count") * DICTIONARY_SHARE >= docs.count())
    return [r["word"] for r in often.collect()]


def candidates(docs: DataFrame, text: str, doc_id: str, path: str) -> DataFrame:
    """One row per candidate: doc_id, start, end, kind, value_sha256, features, and what the rules say of it."""
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    words = dictionary_of(narrow.select("doc_id", "text"))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value_sha256", pa.string()),
         *((f, pa.float64()) for f in FEATURES), ("label", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = frozenset(words)
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = []
                for i, body, where in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("path").to_pylist()):
                    for m in CANDIDATE.finditer(body):
                        kind = m.lastgroup if m.lastgroup != "value" else "assigned"
                        start, end = m.span("value") if m["value"] else m.span()
                        value = body[start:end]
                        values = described(value, body[max(0, start - AROUND) : start], body[end : end + AROUND], where,
                                           kind == "assigned", kind == "known", dictionary)
                        features = dict(zip(FEATURES, values))
                        rows.append({
                            "doc_id": i, "start": start, "end": end, "kind": kind,
                            "value_sha256": hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest(),
                            "label": rule_label(features), **features})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return narrow.mapInArrow(run, "doc_id bigint, start bigint, end bigint, kind string, value_sha256 string, "
                             + ", ".join(f"{f} double" for f in FEATURES) + ", label int")


def scan(
    docs: DataFrame, labelled: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", path: str = "source",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per candidate: doc_id, start, end (characters), kind, value_sha256, score, is_secret.

    `labelled` holds doc_id, start, end and label (0 or 1) of findings somebody judged. Values themselves are never
    returned. With labels of one kind only, or none, the rules alone decide and unsure candidates score 0.5. Null counts as the
    empty text, which has no candidates; repeated rows give repeated findings; an empty table gives an empty result.
    Other columns are not read.
    """
    found = cut(candidates(docs, text, doc_id, path))
    known = found
    if labelled is not None:
        judged = labelled.select("doc_id", "start", "end", F.col("label").cast("int").alias("judged")).dropDuplicates(["doc_id", "start", "end"])
        known = cut(found.drop("label").join(judged, ["doc_id", "start", "end"]).withColumnRenamed("judged", "label"))
    per_label = {r["label"]: r["count"] for r in known.where("label in (0, 1)").groupBy("label").count().collect()}
    columns = ["doc_id", "start", "end", "kind", "value_sha256"]
    if len(per_label) < 2:
        score = F.coalesce(F.col("label").cast("double"), F.lit(0.5))
        return found.select(*columns, score.alias("score"), (score >= threshold).cast("int").alias("is_secret"))
    part = F.pmod(F.xxhash64("doc_id", "start"), F.lit(1_000_000))
    share = F.when(F.col("label") == 1, min(1.0, LABELLED / per_label[1])).otherwise(min(1.0, LABELLED / per_label[0]))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="x")
    sample = cut(known.where("label in (0, 1)").where(part < share * 1_000_000).select(*FEATURES, F.col("label").cast("double").alias("label")))
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="x", numTrees=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False
    ).fit(assembler.transform(sample))
    scored = forest.transform(assembler.transform(found)).withColumn("score", F.round(vector_to_array("probability")[1], 9))
    return scored.select(*columns, "score", (F.col("score") >= threshold).cast("int").alias("is_secret"))
