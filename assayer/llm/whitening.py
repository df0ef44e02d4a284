"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred vectors, one a row, the bidiagonalisation builds orthonormal v's and u's with X v = alpha u + beta u'
and X' u = alpha v + beta v', so X V = U B with B upper bidiagonal; the singular value decomposition of the small B gives
the principal components and deviations of X without its covariance ever being formed.

A u has an entry per row and never leaves the tasks: u = X w for a short w that is carried along. One pass over the
rows' blocks computes u piece by piece, its products X' u, and its products with all earlier u's; their sums over the
tasks are what reaches the driver, one number per dimension and per earlier u. Both bases are reorthogonalised in full;
a u whose products with earlier ones are more than rounding is corrected and passed over again. Where X' u or X v
vanishes (fewer independent rows than dimensions, equal deviations) the next v is a random one orthogonal to all before.
The full number of steps, one per dimension, is taken unless the components wanted have converged to rounding before.

The blocks hold centred entries (x minus the whole part of the mean, minus its fraction) and are written once to the
shared folder, so every pass survives lost executors. Entries, sums and squared deviations are whole numbers and exact.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from assayer.session import cut

# Worker code travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK = 1024  # rows of a block
SATURATED = 2**53  # entries stop here on either side, so that all arithmetic on single entries is exact
NOTHING = 1e-10  # of the largest: no variance, no new direction
ROUNDING = 1e-8  # products of u's below this are removed without another pass
CONVERGED = 1e-15


def whole_vectors(vectors: DataFrame, scale: int, shift: int, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and x = floor(scale * c) + shift; without vectors that are null or hold null or non-finite entries."""
    x = F.col("x")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def number(c):
        bounded = F.greatest(F.least(F.lit(float(scale)) * c, F.lit(float(SATURATED))), F.lit(float(-SATURATED)))
        return F.floor(bounded) + F.lit(shift).cast("long")

    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    return rows.where(sound).withColumn("x", F.transform("x", number))


def matrix(column: pa.Array, width: int, fill: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones are filled up."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.full((len(lengths), width), fill, dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def summed(rows: DataFrame) -> dict[int, object]:
    """Sums of `value` by `key`; there are a few keys for each dimension."""
    return {r["key"]: r["total"] for r in rows.groupBy("key").agg(F.sum("value").alias("total")).collect()}


def sums(rows: DataFrame, width: int, fill: int) -> list[int]:
    """The exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=object)
        for batch in batches:
            x = matrix(batch.column("x"), width, fill)
            for at in range(0, len(x), 256):  # 256 entries of 2 ** 53 do not overflow
                total += x[at : at + 256].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int64()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(28, 0))], names=["key", "value"])

    found = summed(rows.select("x").mapInArrow(run, "key bigint, value decimal(28,0)"))
    return [int(found.get(i, 0)) for i in range(width)]


def centred_blocks(rows: DataFrame, width: int, fill: int, n: int, totals: list[int]) -> DataFrame:
    """Blocks of centred rows, packed; a task's last block is shorter."""
    mean, part = np.array([s // n for s in totals]), np.array([(s % n) / n for s in totals])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                x = matrix(batch.column("x").slice(at, BLOCK), width, fill)
                yield pa.RecordBatch.from_arrays([pa.array([((x - mean) - part).tobytes()], pa.binary())], names=["rows"])

    return cut(rows.select("x").mapInArrow(run, "rows binary"))


def both_products(blocks: DataFrame, width: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With u = X w's last column: X' u, and the products of u with X times every column of w, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + w.shape[1])
        for batch in batches:
            for packed in batch.column("rows"):
                x = np.frombuffer(packed.as_py()).reshape(-1, width)
                u = x @ w
                total[:width] += x.T @ u[:, -1]
                total[width:] += u.T @ u[:, -1]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["key", "value"])

    found = summed(blocks.mapInArrow(run, "key bigint, value double"))
    total = np.array([found.get(i, 0.0) for i in range(width + w.shape[1])])
    return total[:width], total[width:]


def orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalisation(blocks: DataFrame, width: int, norm: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Components (columns) and singular values of the blocks' rows, by falling value; `norm` is the root of the sum of
    all squares."""
    random = np.random.default_rng(11)

    def fresh() -> np.ndarray:
        v = orthogonal(random.standard_normal(width), vs)
        return v / np.linalg.norm(v)

    # us are X @ ws, zero where X v lies in the u's before; images are X' @ us
    vs, ws, images = (np.zeros((width, 0)) for _ in range(3))
    alphas, betas = [], []
    v, beta = fresh(), 0.0
    while True:
        vs = np.column_stack([vs, v])
        w = v - beta * ws[:, -1] if beta else v
        alpha = size = 0.0
        for _ in range(3):
            back, products = both_products(blocks, width, np.column_stack([ws, w]))
            size = np.sqrt(max(products[-1], 0.0))
            if size <= NOTHING * norm:
                w, size = np.zeros(width), 0.0
                break
            off = products[:-1]
            w = w - ws @ off
            if np.linalg.norm(off) <= ROUNDING * size:
                back = back - images @ off
                size = np.sqrt(max(products[-1] - off @ off, 0.0))
                break
        alpha = size
        u_back = back / alpha if alpha else np.zeros(width)
        ws = np.column_stack([ws, w / alpha if alpha else w])
        images = np.column_stack([images, u_back])
        alphas.append(alpha)
        k = len(alphas)
        if k == width:
            break
        new = orthogonal(u_back - alpha * v, vs) if alpha else np.zeros(width)
        beta = float(np.linalg.norm(new))
        if beta <= NOTHING * norm:
            betas.append(0.0)
            v, beta = fresh(), 0.0
            continue
        betas.append(beta)
        v = new / beta
        v = orthogonal(v, vs)
        v /= np.linalg.norm(v)
        if k >= 2 * wanted:
            left, values, _ = np.linalg.svd(bidiagonal(alphas, betas[:-1]))
            if (beta * np.abs(left[-1, :wanted]) <= CONVERGED * values[0]).all():
                break
    _, values, right = np.linalg.svd(bidiagonal(alphas, betas[: len(alphas) - 1]))
    return vs @ right.T, values


def bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas, 1)


def whitened_products(blocks: DataFrame, width: int, project: np.ndarray) -> np.ndarray:
    """Sums of products of the rows' whitened entries."""
    k = project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for packed in batch.column("rows"):
                y = np.frombuffer(packed.as_py()).reshape(-1, width) @ project
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int64()), pa.array(total.reshape(-1))], names=["key", "value"])

    found = summed(blocks.mapInArrow(run, "key bigint, value double"))
    return np.array([found.get(i, 0.0) for i in range(k * k)]).reshape(k, k)


def squared_deviations(x: np.ndarray, n: int, totals: list[int]) -> list[int]:
    """The sum over dimensions of (n * x - S) ** 2 of every row, exact."""
    mean = np.array([s // n for s in totals])
    most = int(np.abs(x - mean).max(initial=0)) + 1
    if (n * most) ** 2 * max(x.shape[1], 1) < 2**63:
        far = (x - mean) * n - np.array([s % n for s in totals])
        return (far * far).sum(axis=1).tolist()
    far = x.astype(object) * n - np.array(totals, dtype=object)
    return (far * far).sum(axis=1).tolist()


OUTPUT = (
    "vec_id bigint, component int, n bigint, deviation {deviation}, whitened double, explained double, identity_error double")


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT,
    vec_id: str = "vec_id", embedding: str = "embedding", exact_type: str = "decimal(38,0)",
) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries are left out; shorter vectors count as filled up with
    zeros; entries beyond 2 ** 53 stop there. Numbers may be null or repeat; each row is a vector of its own. Components
    without variance (as with equal vectors, or fewer vectors than dimensions) have explained 0 and a null `whitened`,
    and `identity_error` leaves them out. A component's largest entry is positive. `deviation` is null where it does
    not fit `exact_type`. An empty table, or one of empty vectors, gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = cut(whole_vectors(vectors, scale, shift, vec_id, embedding))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n or not width:
        return spark.createDataFrame([], OUTPUT.format(deviation=exact_type))
    totals = sums(rows, width, shift)
    blocks = centred_blocks(rows, width, shift, n, totals)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int64()), pa.array([sum(float(np.square(np.frombuffer(b.as_py())).sum()) for batch in batches for b in batch.column("rows"))])],
            names=["key", "value"])

    trace = summed(blocks.mapInArrow(squares, "key bigint, value double")).get(0, 0.0)
    k = min(components, width)
    vs, values = bidiagonalisation(blocks, width, float(np.sqrt(trace)), k) if trace else (np.eye(width), np.zeros(width))
    vs, values = vs[:, :k], values[:k]
    vs = vs * np.sign(vs[np.abs(vs).argmax(axis=0), np.arange(k)])
    alive = values > 1e-7 * values[0]
    explained = np.where(alive, values**2 / trace if trace else 0.0, 0.0)
    project = np.where(alive, vs * np.sqrt(n) / np.where(alive, values, 1.0), 0.0)
    error = 0.0
    if alive.any():
        covariance = whitened_products(blocks, width, project[:, alive]) / n
        error = float(np.abs(covariance - np.eye(int(alive.sum()))).max())
    mean, part = np.array([s // n for s in totals]), np.array([(s % n) / n for s in totals])
    most = 2**63 if exact_type == "bigint" else 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                some = batch.slice(at, BLOCK)
                x = matrix(some.column("x"), width, shift)
                white = ((x - mean) - part) @ project
                deviation = [d if d < most else None for d in squared_deviations(x, n, totals)]
                if exact_type == "bigint":
                    deviation = pa.array(deviation, pa.int64())
                else:
                    deviation = pa.array([None if d is None else Decimal(d) for d in deviation], pa.decimal128(38, 0))
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    some.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n)), deviation.take(pa.array(each)),
                    pa.array(white.reshape(-1), mask=np.tile(~alive, len(x))), pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, OUTPUT.format(deviation=exact_type))
