"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of the lists.

Queries are dealt to blocks and candidates to shards, both of bounded size by a hash of their number. A task gets one
tile, which is one block and one shard, multiplies the two matrices and keeps the k best of each query. The lists of a
query then meet FAN_IN at a time until one is left. The work is queries times candidates, as an exact search needs; no
task holds more than a tile, and nothing is broadcast.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

# Worker code travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERY_BLOCK = 2048  # queries of a tile, on average
SHARD = 4096  # candidates of a tile, on average
ROWS_AT_A_TIME = 256  # queries multiplied at once
FAN_IN = 16
EXACT = 2.0**53  # sums below this are exact in double precision
LONG = 2**63 - 1

PARTIAL = "query_id bigint, shard bigint, top array<struct<worse:bigint,vec_id:bigint>>"


def whole_numbers(vectors: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and v = floor(scale * x); without vectors that are null or hold null or non-finite components."""
    x = F.col("v")
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
        .where(sound)
        .withColumn("v", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c)))
    )


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of whole numbers; shorter vectors count as filled up with zeros."""
    rows = [np.asarray(v, dtype=np.int64) for v in vectors]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def tile_products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; those beyond 64 bits stop at the largest."""
    width = min(queries.shape[1], candidates.shape[1])
    queries, candidates = queries[:, :width], candidates[:, :width]
    if not width:
        return np.zeros((len(queries), len(candidates)), dtype=np.int64)
    high = float(np.abs(queries.astype(float)).max()) * float(np.abs(candidates.astype(float)).max()) * width
    if high < EXACT:
        return (queries.astype(float) @ candidates.T.astype(float)).astype(np.int64)
    exact = queries.astype(object) @ candidates.T.astype(object)
    return np.clip(exact, -LONG, LONG).astype(np.int64)


def tile_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int) -> list[list]:
    """Of each query the k best (minus score, vec_id), best first, without candidates of the query's own number."""
    order = np.argsort(ids, kind="stable")
    ids, candidates, out = ids[order], candidates[order], []
    for at in range(0, len(queries), ROWS_AT_A_TIME):
        worse = -tile_products(queries[at : at + ROWS_AT_A_TIME], candidates)
        own = query_ids[at : at + ROWS_AT_A_TIME, None] == ids[None, :]
        for row, mine in zip(worse, own):
            left, row = ids[~mine], row[~mine]
            if len(row) > k:
                # ids ascend, so of equal scores the first ones have the smaller numbers
                limit = np.partition(row, k - 1)[k - 1]
                better, equal = np.flatnonzero(row < limit), np.flatnonzero(row == limit)
                pick = np.concatenate([better, equal[: k - len(better)]])
                left, row = left[pick], row[pick]
            best = np.lexsort((left, row))
            out.append([{"worse": w, "vec_id": i} for w, i in zip(row[best].tolist(), left[best].tolist())])
    return out


def search(
    vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """The k best candidates of every query: query_id, rank, vec_id, score.

    Queries are the rows whose number is divisible by `every`; candidates are all rows but those of the query's own
    number. Equal scores rank by the smaller number. Rows without a number take no part. A number that occurs several
    times is one query, by its largest vector, and several candidates. Vectors of different lengths are compared as if
    filled up with zeros. An empty table gives an empty result.
    """
    rows = whole_numbers(vectors, scale, vec_id, embedding)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    blocks, shards = max(1, math.ceil(row["q"] / QUERY_BLOCK)), max(1, math.ceil(row["n"] / SHARD))

    def dealt(n: int):
        return F.pmod(F.xxhash64("vec_id"), F.lit(n))

    def all_of(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), dealt(blocks).alias("block")).withColumn("shard", all_of(shards))
    right = rows.select("vec_id", "v", dealt(shards).alias("shard")).withColumn("block", all_of(blocks))

    def run(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "shard": [], "top": []})
        best = tile_top(q["query_id"].to_numpy(), _matrix(q["q"]), c["vec_id"].to_numpy(), _matrix(c["v"]), k)
        return pd.DataFrame({"query_id": q["query_id"], "shard": key[1], "top": best})

    key = ["block", "shard"]
    lists = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, PARTIAL)
    while True:
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        shards = math.ceil(shards / FAN_IN)
        lists = lists.groupBy("query_id", F.floor(F.col("shard") / FAN_IN).alias("shard")).agg(merged.alias("top"))
        if shards == 1:
            break
    return lists.select("query_id", F.posexplode("top").alias("at", "best")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "best.vec_id", (-F.col("best.worse")).alias("score"))
