"""Near-duplicate documents by DartMinHash signatures.

A text is the set of its five-word shingles (or the multiset: a shingle that occurs w times has weight w). Darts are
thrown at the region of every shingle, whose width is its weight: their ranks form a random process that depends on
the shingle alone, so that all texts with the shingle see the same darts. Of the darts that fall on a coordinate of the
signature the one of the lowest rank is kept. Only ranks up to a bound are thrown, about k ln k + 2k darts for a text of
any length; if a coordinate gets none, the bound is doubled. Two texts agree in a coordinate with probability equal to
their weighted Jaccard similarity.

Texts with equal shingle sets are one vertex. Signatures are joined by bands. Within a band's bucket the members are
compared with a few hubs, not with one another; texts whose similarity, computed exactly on the shingles, is at least
the threshold are linked. Buckets whose members are not yet in one class get more hubs, in a few turns. Members of
buckets that are still open then meet across classes, but only where they share one of their rarest shingles, as every
pair at the threshold must; so no link is lost, and a crowd around one template does not meet as a square of pairs.
Classes are the connected components.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from assayer.llm.groups import by_place, by_salt, salt_of, salted_totals, text_key
from assayer.llm.ngrams import Words, mix, ngram_hashes, text_slices
from assayer.operators.components import components
from assayer.session import cut

# Worker code travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
SIMILARITY = 0.8
# 25 bands of 5: a pair at the threshold shares a band with probability 1 - (1 - 0.8^5)^25 > 0.9999
BANDS, ROWS = 25, 5
HUBS = (1, 4)  # hubs of a bucket, turn by turn; members of one class meet no further ones
SIZE_RATIO = 1.05  # between the bands of sizes in the join for what hubs leave
ORDERED_BY, COMMON = 16, 1 << 20  # one set in so many tells which cells are common; so many are told at most

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the index of their text, sorted by text and hash, repeats included.

    A text of fewer than n words has one shingle, all its words.
    """
    hashes = words.hashes()
    starts, text = words.windows(n)
    found, owner = [ngram_hashes(hashes, starts, n)], [text]
    for length in range(1, n):
        short = np.flatnonzero(words.counts == length)
        found.append(ngram_hashes(hashes, words.first[short], length, seed=length))
        owner.append(short)
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((found, owner))
    return found[order], owner[order]


def cells(shingles: np.ndarray, owner: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Regions of width 1: a shingle of weight w has the cells 1 to w; unweighted, every shingle has one."""
    if not len(shingles):
        return shingles, owner
    new = np.append(True, (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1]))
    if not weighted:
        return shingles[new], owner[new]
    at = np.flatnonzero(new)
    nth = np.arange(len(shingles)) - np.repeat(at, np.diff(np.append(at, len(shingles))))
    return mix(shingles + nth.astype(np.uint64) * GOLDEN), owner


def dart_signatures(cell: np.ndarray, owner: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """One row of k coordinates per text: the dart of the lowest rank on each. Texts without cells have zeros."""
    signature = np.zeros((n_texts, k), dtype=np.uint64)
    width = np.bincount(owner, minlength=n_texts)
    bound = (k * np.log(k) + 2 * k) / np.maximum(width, 1)
    todo = width > 0
    while todo.any():
        use = todo[owner]
        seed, text = cell[use], owner[use]
        rank = np.zeros(len(seed))
        lowest, darts = np.full(n_texts * k, np.inf), []
        step = np.zeros(1, dtype=np.uint64)
        while len(seed):
            # the gaps between the ranks of a cell's darts are exponential, as in a Poisson process
            step += GOLDEN
            dart = mix(seed + step)
            rank = rank - np.log(((dart >> np.uint64(11)).astype(float) + 1) / 2.0**53)
            inside = rank <= bound[text]
            seed, text, rank, dart = seed[inside], text[inside], rank[inside], dart[inside]
            dart = mix(dart)
            at = text * k + (dart % np.uint64(k)).astype(np.int64)
            np.minimum.at(lowest, at, rank)
            darts.append((at, rank, dart))
        for at, rank, dart in darts:
            first = lowest[at] == rank
            signature.reshape(-1)[at[first]] = dart[first]
        todo = todo & np.isinf(lowest.reshape(n_texts, k)).any(axis=1)
        bound = np.where(todo, bound * 2, bound)
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signature), bands), dtype=np.uint64)
    for b in range(bands):
        for r in range(rows):
            out[:, b] = mix(out[:, b] * GOLDEN + signature[:, b * rows + r] + np.uint64(b))
    return out.view(np.int64)


def signatures(
    docs: DataFrame, text: str, doc_id: str, n: int, bands: int, rows: int, weighted: bool
) -> DataFrame:
    """doc_id, _key, n_cells, digest of the shingle set, and one key per band; texts without words have no digest and no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                words = Words(part.column("_text").to_pylist())
                cell, owner = cells(*shingle_sets(words, n), weighted)
                width = np.bincount(owner, minlength=len(part))
                ends = np.cumsum(width)
                digests = [
                    hashlib.blake2b(cell[e - w : e].tobytes(), digest_size=16).digest()
                    for e, w in zip(ends.tolist(), width.tolist())
                ]
                keys = band_keys(dart_signatures(cell, owner, len(part), bands * rows), bands, rows)
                worded = width > 0
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum(worded) * bands).astype(np.int32)), pa.array(keys[worded].reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("_key"), pa.array(width), pa.array(digests, pa.binary(), mask=~worded), lists],
                    names=["doc_id", "_key", "n_cells", "digest", "bands"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), "_key", F.col(text).alias("_text"))
    return narrow.mapInArrow(run, "doc_id bigint, _key binary, n_cells bigint, digest binary, bands array<bigint>")


def cell_table(docs: DataFrame, text: str, vertex: str, n: int, weighted: bool) -> DataFrame:
    """The vertex, as doc_id, and its sorted cells, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "_text"):
                cell, owner = cells(*shingle_sets(Words(part.column("_text").to_pylist()), n), weighted)
                bounds = np.searchsorted(owner, np.arange(len(part) + 1)).tolist()
                packed = [np.sort(cell[a:b]).tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "cells"])

    narrow = docs.select(F.col(vertex).alias("doc_id"), F.col(text).alias("_text"))
    return narrow.mapInArrow(run, "doc_id bigint, cells binary")


def linked(pairs: DataFrame, cell_sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is at least the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                left = np.frombuffer(left.as_py(), dtype=np.uint64)
                right = np.frombuffer(right.as_py(), dtype=np.uint64)
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(common >= similarity * (len(left) + len(right) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    # the sets of the hubs come last, so the sets of the many members travel once per hub
    both = pairs.join(cell_sets.toDF("b", "right"), "b").join(cell_sets.toDF("a", "left"), "a")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def classes(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
    weighted: bool = False, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per input row: doc_id and class_id, the smallest doc_id among the texts it is linked to, directly or over others.

    Texts without words (null, empty, white space) are linked to nothing: their class is their own number. Rows that
    repeat a number repeat its class if their texts are equal; rows of one number with different texts are documents of
    their own. Rows without a number keep a null class. An empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = _placed(docs, similarity, shingle, bands, rows, weighted).select("doc_id", "class_id")
    unknown = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return placed.unionByName(unknown)


def _placed(docs: DataFrame, similarity: float, shingle: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """doc_id, _key and class_id of every row (doc_id, text) that has a number, and whether it stays for its class."""
    known = docs.where("doc_id is not null").withColumn("_key", text_key(F.col("text")))
    every = cut(signatures(known, "text", "doc_id", shingle, bands, rows, weighted)).withColumn("_salt", salt_of("doc_id"))
    found = every.where("digest is not null")

    # texts with equal sets are one vertex, known by a number of its own: a doc_id may have several texts
    sets = cut(salted_totals(found, ["digest"], [F.struct("doc_id", "_key")]).select(
        "digest", F.col("hubs")[0]["doc_id"].alias("doc_id"), F.col("hubs")[0]["_key"].alias("_key"), "_mask",
        F.monotonically_increasing_id().alias("vertex")))
    first = ["digest", "doc_id", "_key"]  # the row that stands for the vertex
    vertices = found.drop("_salt").join(sets.select(*first, "vertex"), first).dropDuplicates(first).select(
        F.col("vertex").alias("doc_id"), "n_cells", "bands")

    keys = vertices.select("doc_id", "n_cells", salt_of("doc_id").alias("_salt"), F.posexplode("bands").alias("band", "key"))
    members = _members(keys)
    involved = sets.join(members.select(F.col("doc_id").alias("vertex")).distinct(), "vertex").select("doc_id", "_key", "vertex")
    texts = known.join(involved, ["doc_id", "_key"]).dropDuplicates(["doc_id", "_key"])
    cell_sets = cut(cell_table(texts, "text", "vertex", shingle, weighted))

    tried, links, roots = None, None, None
    for turn, hubs in enumerate(HUBS):
        pairs = _pairs_with_hubs(members, roots, turn, hubs, similarity)
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        new = cut(linked(pairs, cell_sets, similarity))
        links = new if links is None else links.union(new)
        if new.count() or roots is None:
            roots = components(links)
    rest = cut(_pairs_across(members, roots, cell_sets, similarity).join(tried, ["a", "b"], "left_anti"))
    new = cut(linked(rest, cell_sets, similarity))
    if new.count():
        roots = components(links.union(new))

    # a class may hold most of the vertices, so it, too, is combined and met by salt
    rooted = sets.join(roots.toDF("vertex", "root"), "vertex", "left").select(
        "digest", "doc_id", "_key", "_mask", F.coalesce("root", "vertex").alias("root"), salt_of("vertex").alias("_part"))
    keepers = salted_totals(rooted, ["root"], [F.struct("doc_id", "_key")], "_part").select("root", "_mask", F.col("hubs")[0].alias("keeper"))
    vertex_class = cut(rooted.join(by_salt(keepers, "_part"), ["root", "_part"]).select("digest", "_mask", "keeper"))
    placed = found.select("doc_id", "_key", "digest", "_salt").join(by_salt(vertex_class), ["digest", "_salt"]).select(
        "doc_id", "_key", F.col("keeper.doc_id").alias("class_id"),
        ((F.col("doc_id") == F.col("keeper.doc_id")) & (F.col("_key") == F.col("keeper._key"))).alias("stays"))
    return placed.unionByName(every.where("digest is null").select(
        "doc_id", "_key", F.col("doc_id").alias("class_id"), F.lit(True).alias("stays")))


def _members(keys: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one text."""
    shared = salted_totals(keys, ["band", "key"], []).where("n > 1").drop("hubs", "n")
    return cut(keys.join(by_salt(shared), ["band", "key", "_salt"]))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _close_in_size(one: str, other: str, similarity: float):
    """No pair of these sizes is similar enough otherwise."""
    return F.least(one, other) >= F.greatest(one, other) * F.lit(similarity) - 1e-9


def _open_members(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members of the buckets that hold several classes, with their class."""
    if roots is None:
        return members.withColumn("root", F.col("doc_id"))
    placed = cut(members.join(roots.toDF("doc_id", "root"), "doc_id", "left").withColumn(
        "root", F.coalesce("root", "doc_id")))
    parts = placed.groupBy("band", "key", "_salt").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    several = parts.groupBy("band", "key").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_mask")
    ).where("low < high").drop("low", "high")
    return cut(placed.join(by_salt(several), ["band", "key", "_salt"]))


def _pairs_with_hubs(members: DataFrame, roots: DataFrame | None, turn: int, n_hubs: int, similarity: float) -> DataFrame:
    """Every member of an open bucket with the bucket's hubs of this turn."""
    rows = _open_members(members, roots)
    # a hub has the least of a hash; bands differ in the hash, too, so a large group has several hubs from the start
    place = [F.col("doc_id").alias("id"), F.col("n_cells").alias("size"), F.col("root").alias("root")]
    least = [F.struct(F.xxhash64("doc_id", F.lit(turn), F.lit(i), F.col("band") % 4).alias("h"), *place) for i in range(n_hubs)]
    hubs = by_salt(salted_totals(rows, ["band", "key"], least).drop("n")).withColumn("hub", F.explode("hubs"))
    met = rows.join(hubs, ["band", "key", "_salt"]).where(
        (F.col("doc_id") != F.col("hub.id")) & (F.col("root") != F.col("hub.root"))
        & _close_in_size("n_cells", "hub.size", similarity))
    return met.select(*_ordered("doc_id", "hub.id")).distinct()


def least_overlap(x, y, similarity: float):
    """Cells that sets of x and y cells share at least if they are similar enough."""
    return np.ceil(similarity / (1 + similarity) * (np.asarray(x) + y) - 1e-9)


def size_band(size) -> np.ndarray:
    return np.floor(np.log(size) / np.log(SIZE_RATIO) + 1e-9).astype(np.int64)


def rare_prefixes(cell: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, band, place) of the rows that stand for a set in the join for pairs; place is negative in a partner's role.

    In one order of all cells, rare ones first, similar sets share a cell among the first few: with x <= y cells and an
    overlap of a, one of the first x - a + 1 of the smaller and the first y - a + 1 of the larger. As the smaller, a set
    offers the cells that suffice for a partner of its own size, in its own band of sizes; as the larger, it asks with
    each cell in the bands of those smaller sizes that the place of the cell still allows.
    """
    y = len(cell)
    at = np.searchsorted(common, cell)
    known = common[np.minimum(at, len(common) - 1)] == cell if len(common) else np.zeros(y, dtype=bool)
    ordered = cell[np.lexsort((cell, known))]
    offered = int(y - least_overlap(y, y, similarity)) + 1
    low = int(np.ceil(similarity * y - 1e-9))
    asked = np.arange(int(y - least_overlap(low, y, similarity)) + 1)
    # the largest x with place <= y - least_overlap(x, y)
    high = np.minimum(np.floor((y - asked) * (1 + similarity) / similarity + 1e-9) - y, y)
    first, last = size_band(low), size_band(np.maximum(high, low))
    n = np.where(high >= low, last - first + 1, 0)
    place = np.repeat(asked, n)
    band = first + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    return (np.concatenate([ordered[:offered], ordered[place]]),
            np.concatenate([np.full(offered, size_band(y)), band]),
            np.concatenate([np.arange(offered), -1 - place]))


def _common_cells(sets: DataFrame) -> np.ndarray:
    """Cells that many sets hold, sorted; at most COMMON, known from a share of the sets.

    They only put cells in order: any order gives the same pairs, and this one keeps what a crowd shares out of the join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells_of in batch.column("cells"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(cells_of.as_py(), dtype=np.int64))], names=["cell"])

    some = sets.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(ORDERED_BY)) == 0).select("cells")
    counted = some.mapInArrow(run, "cell bigint").groupBy("cell").count().where("count > 1").orderBy(F.desc("count"), "cell").limit(COMMON)
    return np.sort(np.array([r["cell"] for r in counted.select("cell").collect()], dtype=np.int64).view(np.uint64))


def _pairs_across(members: DataFrame, roots: DataFrame, cell_sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of members of open buckets that lie in different classes and may be similar enough.

    Not the pairs of a bucket, of which a crowd around one template would have the square: pairs must share a rare cell.
    """
    open_ones = _open_members(members, roots).groupBy("doc_id").agg(F.first("root").alias("root"))
    sets = cut(open_ones.join(cell_sets, "doc_id"))
    common = sets.sparkSession.sparkContext.broadcast(_common_cells(sets))  # at most COMMON numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, root, packed in zip(*[batch.column(c) for c in ("doc_id", "root", "cells")]):
                cell = np.frombuffer(packed.as_py(), dtype=np.uint64)
                token, band, place = rare_prefixes(cell, common.value, similarity)
                n = len(token)
                yield pa.RecordBatch.from_arrays([
                    pa.array(token.view(np.int64)), pa.array(band), pa.array(place), pa.array(np.full(n, doc_id.as_py())),
                    pa.array(np.full(n, root.as_py())), pa.array(np.full(n, len(cell)))], names=["token", "band", "place", "id", "root", "size"])

    rows = cut(sets.mapInArrow(run, "token bigint, band bigint, place bigint, id bigint, root bigint, size bigint"))
    smaller = rows.where("place >= 0").toDF("token", "band", "place", "a_id", "a_root", "a_size")
    larger = rows.where("place < 0").select("token", "band", (-1 - F.col("place")).alias("b_place"), F.col("id").alias("b_id"),
                                            F.col("root").alias("b_root"), F.col("size").alias("b_size"))
    overlap = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("a_size") + F.col("b_size")) - 1e-9)
    return smaller.join(larger, ["token", "band"]).where(
        (F.col("a_root") != F.col("b_root")) & (F.col("a_size") <= F.col("b_size")) & _close_in_size("a_size", "b_size", similarity)
        & (F.col("place") <= F.col("a_size") - overlap) & (F.col("b_place") <= F.col("b_size") - overlap)
    ).select(*_ordered("a_id", "b_id")).distinct()


def drop_near_copies(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
    weighted: bool = False, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One document of each class, the one with the smallest number; all its columns, whatever their names.

    Of texts that share this number the one with the smallest digest stays; rows that repeat number and text stay
    together. Rows without a number all stay. An empty table stays empty.
    """
    plain, (text, doc_id) = by_place(docs, text, doc_id)
    narrow = plain.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    others = _placed(narrow, similarity, shingle, bands, rows, weighted).where("not stays").select(
        F.col("doc_id").alias("_other"), F.col("_key").alias("_other_key")).distinct()
    same = (F.col(doc_id) == F.col("_other")) & (text_key(F.col(text)) == F.col("_other_key"))
    return plain.join(others, same, "left_anti").toDF(*docs.columns)
