"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text are computed once per document. Cosines of random projections approximate a Gaussian
kernel over them. Every partition sums its share of the normal equations; the sums, whose size is fixed by the number
of features, are added up and solved. Scores of labelled documents that took no part in the fit are counted in narrow
bins, and the bins are pooled until the rate of good documents rises with the score.

Only the statistics of a text are inputs. All labelled rows outside the held-out part are used, none is sampled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm.groups import by_place, text_key
from assayer.llm.ngrams import Words, text_slices
from assayer.session import cut

# Worker code travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = 256  # random Fourier features
RIDGE = 1.0
SEED = 4
BINS = 2000  # of the raw score, over RANGE
RANGE = (-0.5, 1.5)
THRESHOLD = 0.3

SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[]_`{|}~"
STATISTICS = [
    "log_words", "log_bytes", "word_length", "upper", "digit", "space", "line", "beyond_ascii", "distinct", "top_word",
    "next_same", "line_distinct", "short", "capitals", *[f"symbol_{i}" for i in range(len(SYMBOLS))],
]


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of STATISTICS per text. Null counts as empty; an empty text has zeros."""
    words = Words(texts)
    out = np.zeros((len(texts), len(STATISTICS)))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            continue
        counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        n = len(raw)
        mine = words.data[words.starts[words.first[i]] : words.ends[words.first[i + 1] - 1]].split() if words.counts[i] else []
        n_words = max(len(mine), 1)
        often: dict[bytes, int] = {}
        for w in mine:
            often[w] = often.get(w, 0) + 1
        lines = raw.split(b"\n")
        out[i, :14] = (
            np.log1p(len(mine)), np.log1p(n), sum(map(len, mine)) / n_words / 10,
            counts[65:91].sum() / n, counts[48:58].sum() / n, counts[32] / n, counts[10] / n, counts[128:].sum() / n,
            len(often) / n_words, max(often.values(), default=0) / n_words,
            sum(a == b for a, b in zip(mine, mine[1:])) / n_words, len(set(lines)) / len(lines),
            sum(len(w) == 1 for w in mine) / n_words, sum(w.isupper() for w in mine) / n_words,
        )
        out[i, 14:] = np.sqrt(counts[list(SYMBOLS)] / n)
    return out


def statistics_of(docs: DataFrame, text: str, doc_id: str, keyed: bool = False) -> DataFrame:
    """doc_id and its statistics, written once so that texts are read once; with the text's _key if `keyed`."""
    more = ["_key"] if keyed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                made = statistics(part.column("_text").to_pylist()).astype(np.float32)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(part) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists, *[part.column(c) for c in more]], names=["doc_id", "x", *more])

    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"), *[text_key(F.col(text)).alias(c) for c in more])
    return cut(narrow.mapInArrow(run, "doc_id bigint, x array<float>" + "".join(f", {c} binary" for c in more)))


def fold(doc_id: Column) -> Column:
    """crc32 of the number as text, modulo 5; a null number counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


class Kernel:
    """Standardised statistics to random Fourier features, with a constant as the last."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, seed: int):
        random = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        # a width at which typical squared distances of standardised rows are about one
        self.weights = random.normal(size=(len(mean), features)) / np.sqrt(2 * len(mean))
        self.phase = random.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        waves = np.cos(z @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([waves, np.ones((len(x), 1))])


def normal_equations(labelled: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over all rows (x, y), added up partition by partition."""
    size = len(kernel.phase) + 1

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for frame in frames:
            if len(frame):
                z = kernel(np.stack(frame["x"].to_numpy()).astype(float))
                total += z.T @ np.hstack([z, frame["y"].to_numpy(dtype=float)[:, None]])
        yield pd.DataFrame({"row": np.arange(size), "branch": TaskContext.get().partitionId() % 32, "v": list(total)})

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": [key[0]], "branch": [0], "v": [np.sum(np.stack(frame["v"].to_numpy()), axis=0)]})

    shape = "row int, branch int, v array<double>"
    parts = labelled.select("x", "y").mapInPandas(sums, shape)
    # first in branches, so that no task adds up the parts of all partitions
    rows = parts.groupBy("row", "branch").applyInPandas(add, shape).groupBy("row").applyInPandas(add, shape).collect()
    total = np.zeros((size, size + 1))
    for row in rows:
        total[row["row"]] = row["v"]
    return total[:, :size], total[:, size]


def pooled(edges: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: bin centres and rates that never fall, by pooling neighbours that do."""
    blocks: list[list[float]] = []  # rate, weight, first, last
    for i in np.flatnonzero(n):
        blocks.append([good[i] / n[i], n[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            rate, weight, _, last = blocks.pop()
            top = blocks[-1]
            top[0] = (top[0] * top[1] + rate * weight) / (top[1] + weight)
            top[1], top[3] = top[1] + weight, last
    x = np.array([edges[int(b[k]) + (k == 3)] for b in blocks for k in (2, 3)])
    y = np.array([b[0] for b in blocks for _ in (2, 3)])
    return x, y


def score(
    docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id",
    features: int = FEATURES, ridge: float = RIDGE, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    Labels are learnt from rows whose fold is not 0; fold 4 calibrates and the others fit. Labels that are neither 0
    nor 1 are left out; several labels of one document all count. Without any label every score is 0.5. Null counts as
    the empty text, which is scored like any other. An empty table gives an empty result; other columns are not read.
    """
    return _scored(docs, labels, label, text, doc_id, features, ridge, threshold)


def _scored(
    docs: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str, features: int, ridge: float, threshold: float,
    keyed: bool = False,
) -> DataFrame:
    found = statistics_of(docs, text, doc_id, keyed)
    more = ["_key"] if keyed else []
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(
        F.col("y").isin(0.0, 1.0) & (fold(F.col("doc_id")) != 0))
    labelled = cut(found.join(truth, "doc_id").withColumn("fold", fold(F.col("doc_id"))))

    width = len(STATISTICS)
    row = labelled.agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"),
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(width)]).first()
    base = 0.5 if row["rate"] is None else float(row["rate"])
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(width)])
    deviation = np.array([row[f"s{i}"] or 0.0 for i in range(width)])
    kernel = Kernel(mean, deviation, features, SEED)
    fit_rows = labelled.where("fold <> 4").withColumn("y", F.col("y") - base)
    gram, moment = normal_equations(fit_rows, kernel)
    coefficients = np.linalg.solve(gram + ridge * np.eye(len(gram)), moment)

    def raw(x: np.ndarray) -> np.ndarray:
        return kernel(x) @ coefficients + base

    def bins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                s = np.clip(raw(np.stack(frame["x"].to_numpy()).astype(float)), *RANGE)
                at = np.minimum(((s - RANGE[0]) / (RANGE[1] - RANGE[0]) * BINS).astype(int), BINS - 1)
                yield pd.DataFrame({"bin": at, "y": frame["y"].to_numpy(dtype=float)})

    counted = labelled.where("fold = 4").select("x", "y").mapInPandas(bins, "bin int, y double").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).collect()  # a row per bin
    n, good = np.zeros(BINS), np.zeros(BINS)
    for r in counted:
        n[r["bin"]], good[r["bin"]] = r["n"], r["good"]
    x, y = pooled(np.linspace(*RANGE, BINS + 1), n, good)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
            s = raw(values.astype(float))
            s = np.interp(s, x, y) if len(x) else np.full(len(s), base)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.round(np.clip(s, 0, 1), 9)), *[batch.column(c) for c in more]],
                names=["doc_id", "score", *more])

    scored = found.mapInArrow(apply, "doc_id bigint, score double" + "".join(f", {c} binary" for c in more))
    return scored.select(
        "doc_id", *more, (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(
    docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id",
    features: int = FEATURES, ridge: float = RIDGE, threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows that are not rejected, with all their columns, whatever their names, each judged by its own text.

    Rows without a number all stay; rows that repeat number and text share their fate. An empty table stays empty.
    """
    plain, (text, doc_id) = by_place(docs, text, doc_id)
    rejected = _scored(plain, labels, label, text, doc_id, features, ridge, threshold, keyed=True).where("predicted = 0").select(
        F.col("doc_id").alias("_rejected"), F.col("_key").alias("_rejected_key")).distinct()
    same = (F.col(doc_id) == F.col("_rejected")) & (text_key(F.col(text)) == F.col("_rejected_key"))
    return plain.join(rejected, same, "left_anti").toDF(*docs.columns)
