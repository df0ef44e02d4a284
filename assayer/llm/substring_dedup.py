"""Substring deduplication by fixed-block anchors.

A repeat of 13 words holds a whole block of 7 words of the document it repeats, wherever the blocks of 7 begin. So the
non-overlapping blocks of every document are the index, and the windows of 7 words at every place of every document are
probed against it. Around the hits, and only there, all windows of 13 words are then compared, which extends each hit
to the whole of its repeat: the words that matched windows cover.

Both steps send hashes in packed lists, one per slice of texts and shard of hashes, and both settle inside the slice
what can be settled there: of a window that several documents of a slice share, one document's stands for all. So a
passage that a third of all documents share gives a shard one entry per slice, not one per document. The first step is
a filter and may let too much through; its hashes have 32 bits besides the shard. The second decides, by 96 bits.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from assayer.llm.ngrams import Words, mix, ngram_hashes, text_slices
from assayer.session import cut

# Worker code travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
SEGMENT = 32  # words; hits of the first step are kept by segment
SLICE_BYTES = 8 << 20
SHARD_BYTES = 16 << 20  # text per shard of hashes

PACKED = "shard int, docs binary, first binary, a binary, b binary, c binary, a2 binary, c2 binary, out_docs binary, out binary"
SPREAD = "bucket int, docs binary, places binary"
FOUND = "doc_id bigint, places binary"


def packed_row(shard: int, **arrays: np.ndarray) -> dict:
    names = ["docs", "first", "a", "b", "c", "a2", "c2", "out_docs", "out"]
    return {"shard": shard} | {n: arrays[n].tobytes() if n in arrays else b"" for n in names}


def planes(values: np.ndarray) -> np.ndarray:
    """Sorted 32-bit numbers byte by byte, highest bytes first; these repeat, so that they take little room."""
    return np.ascontiguousarray(values.astype(">u4").view(np.uint8).reshape(-1, 4).T)


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view(">u4").reshape(-1).astype(np.uint32)


def by_document(docs: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Distinct places of each document, packed."""
    if not len(docs):
        return
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    new = np.append(True, (docs[1:] != docs[:-1]) | (places[1:] != places[:-1]))
    docs, places = docs[new], places[new]
    edges = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(docs)]):
        yield int(docs[a]), places[a:b].astype("<u4").tobytes()


def spread(docs: np.ndarray, places: np.ndarray, buckets: int) -> pd.DataFrame:
    """Places with their documents, one row per bucket of documents, so that rows do not grow as shards times documents."""
    bucket = (mix(docs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    used, at = np.unique(bucket[order], return_index=True)
    parts = [order[a:b] for a, b in zip(at, [*at[1:], len(order)])]
    return pd.DataFrame({
        "bucket": used, "docs": [docs[p].astype(np.int64).tobytes() for p in parts],
        "places": [places[p].astype(np.uint32).tobytes() for p in parts]})


def gathered(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per document of a bucket, with all its places."""
    docs = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in frame["docs"]])
    places = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in frame["places"]])
    return pd.DataFrame(list(by_document(docs, places)), columns=["doc_id", "places"])


def least_per_key(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the least value of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.minimum.reduceat(values, at)


def look_up(keys: np.ndarray, table: np.ndarray, values: np.ndarray, missing) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), missing)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], missing)


HIGHEST, LOWEST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


# ---- first step: blocks and probes ----

def anchor_lists(ids: np.ndarray, texts: list[str | None], block: int, shards: int) -> Iterator[dict]:
    """The slice's index blocks (a, b) and probes (a2, c2) by shard; `out`: segments already known as hits.

    a, a2: hashes; b, c2: segments, numbered through the documents of the list, 0 for a document's place that is not
    needed any more.
    """
    words = Words(texts)
    starts, text = words.windows(block)
    if not len(starts):
        return
    h = ngram_hashes(words.hashes(), starts, block)
    place = starts - words.first[text]
    segments = words.counts // SEGMENT + 1
    first = np.cumsum(segments) - segments
    shard = (h >> np.uint64(40)) % np.uint64(shards)
    order = np.lexsort((h & np.uint64(0xFFFFFFFF), shard))
    h, shard, text, place = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], shard[order].astype(np.int64), text[order], place[order]
    edge = np.append(True, (h[1:] != h[:-1]) | (shard[1:] != shard[:-1]))
    group = np.cumsum(edge) - 1
    at = np.flatnonzero(edge)
    doc = ids[text]
    low, high = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
    shared = (low < high)[group]
    aligned = place % block == 0
    # a window that documents of this slice share is a hit; the least block and the largest probe stand for all
    lowest_block = np.full(len(at), HIGHEST)
    np.minimum.at(lowest_block, group[aligned], doc[aligned])
    stand_block = shared & aligned & (doc == lowest_block[group])
    stand_probe = shared & (doc == high[group])
    for mask in (stand_block, stand_probe):
        picked = np.flatnonzero(mask)
        mask[picked[1:]] = group[picked[1:]] != group[picked[:-1]]
    block_rows = np.flatnonzero((~shared & aligned) | stand_block)
    probe_rows = np.flatnonzero(~shared | stand_probe)
    ordinal = first[text] + place // SEGMENT
    bounds = [np.searchsorted(shard[rows], np.arange(shards + 1)) for rows in (block_rows, probe_rows)]
    hits = np.flatnonzero(shared)
    turn = 0
    for s in range(shards):
        i, j = block_rows[bounds[0][s] : bounds[0][s + 1]], probe_rows[bounds[1][s] : bounds[1][s + 1]]
        if not len(i) and not len(j):
            continue
        used, renumbered = np.unique(text[np.concatenate([i, j])], return_inverse=True)
        size = segments[used]
        begin = np.cumsum(size) - size
        shift = (begin[renumbered] - first[used][renumbered])
        width = np.uint16 if size.sum() < 65536 else np.uint32
        places = (ordinal[np.concatenate([i, j])] + shift).astype(width)
        out = hits if turn == 0 else hits[:0]
        turn += 1
        yield packed_row(
            s, docs=ids[used], first=begin.astype(np.uint32), a=planes(h[i]), b=places[: len(i)], a2=planes(h[j]),
            c2=places[len(i) :], c=np.array([np.dtype(width).itemsize], dtype=np.uint8),
            out_docs=doc[out], out=(place[out] // SEGMENT).astype(np.uint32))


def anchor_hits(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Segments of a shard that hold a hit, on either side of it."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("bh", "bd", "bs", "ph", "pd", "ps", "od", "os")}
    for row in frame.itertuples(index=False):
        docs, first = np.frombuffer(row.docs, dtype=np.int64), np.frombuffer(row.first, dtype=np.uint32).astype(np.int64)
        width = np.uint16 if row.c[0] == 2 else np.uint32
        for hashes, places, side in ((row.a, row.b, "b"), (row.a2, row.c2, "p")):
            at = np.frombuffer(places, dtype=width).astype(np.int64)
            owner = np.searchsorted(first, at, side="right") - 1
            parts[side + "h"].append(from_planes(hashes))
            parts[side + "d"].append(docs[owner])
            parts[side + "s"].append((at - first[owner]).astype(np.uint32))
        parts["od"].append(np.frombuffer(row.out_docs, dtype=np.int64))
        parts["os"].append(np.frombuffer(row.out, dtype=np.uint32))
    bh, bd, bs, ph, pd_, ps, od, os_ = (np.concatenate(parts[k]) for k in ("bh", "bd", "bs", "ph", "pd", "ps", "od", "os"))
    table, lowest = least_per_key(bh, bd)
    probe_hit = look_up(ph, table, lowest, HIGHEST) < pd_
    keys, highest = least_per_key(ph, -pd_)
    block_hit = -look_up(bh, keys, highest, HIGHEST) > bd
    docs = np.concatenate([pd_[probe_hit], bd[block_hit], od])
    places = np.concatenate([ps[probe_hit], bs[block_hit], os_])
    return spread(docs, places, buckets)


# ---- second step: windows around hits ----

def window_lists(ids: np.ndarray, texts: list[str | None], segments: list[bytes], window: int, shards: int) -> Iterator[dict]:
    """The slice's windows near hits by shard; `out`: windows that a smaller document of the slice repeats.

    a: 64 bits of hash; b: 32 more; c: place; a2: index of the document.
    """
    words = Words(texts)
    starts, text = words.windows(window)
    if not len(starts):
        return
    place = starts - words.first[text]
    per_text = words.counts // SEGMENT + 2
    first = np.cumsum(per_text) - per_text
    marked = np.zeros(per_text.sum(), dtype=bool)
    for i, packed in enumerate(segments):
        at = np.frombuffer(packed, dtype="<u4").astype(np.int64)
        marked[first[i] + at[at < per_text[i]]] = True
    # the hit lies within the first words of the window
    reach = (window + 1) // 2 - 1
    near = marked[first[text] + place // SEGMENT] | marked[first[text] + (place + reach) // SEGMENT]
    starts, text, place = starts[near], text[near], place[near]
    if not len(starts):
        return
    hashes = words.hashes()
    h, more = ngram_hashes(hashes, starts, window), ngram_hashes(hashes, starts, window, seed=1).astype(np.uint32)
    doc = ids[text]
    order = np.lexsort((doc, more, h, h % np.uint64(shards)))
    h, more, text, place, doc = h[order], more[order], text[order], place[order], doc[order]
    edge = np.append(True, (h[1:] != h[:-1]) | (more[1:] != more[:-1]))
    lowest = doc[edge][np.cumsum(edge) - 1]
    repeats = doc > lowest
    out = np.flatnonzero(repeats)
    rows = np.flatnonzero(~repeats)
    bounds = np.searchsorted((h[rows] % np.uint64(shards)).astype(np.int64), np.arange(shards + 1))
    turn = 0
    for s in range(shards):
        i = rows[bounds[s] : bounds[s + 1]]
        if not len(i):
            continue
        used, renumbered = np.unique(text[i], return_inverse=True)
        sent = out if turn == 0 else out[:0]
        turn += 1
        yield packed_row(
            s, docs=ids[used], a=h[i], b=more[i], c=place[i].astype(np.uint32), a2=renumbered.astype(np.uint32),
            out_docs=doc[sent], out=place[sent].astype(np.uint32))


def repeated_windows(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Windows of a shard that a smaller document holds as well."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("h", "m", "d", "p", "od", "op")}
    for row in frame.itertuples(index=False):
        docs = np.frombuffer(row.docs, dtype=np.int64)
        parts["h"].append(np.frombuffer(row.a, dtype=np.uint64))
        parts["m"].append(np.frombuffer(row.b, dtype=np.uint32))
        parts["p"].append(np.frombuffer(row.c, dtype=np.uint32))
        parts["d"].append(docs[np.frombuffer(row.a2, dtype=np.uint32)])
        parts["od"].append(np.frombuffer(row.out_docs, dtype=np.int64))
        parts["op"].append(np.frombuffer(row.out, dtype=np.uint32))
    h, m, d, p, od, op = (np.concatenate(parts[k]) for k in ("h", "m", "d", "p", "od", "op"))
    order = np.lexsort((d, m, h))
    h, m, d, p = h[order], m[order], d[order], p[order]
    edge = np.append(True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])) if len(h) else np.zeros(0, dtype=bool)
    repeats = d > d[edge][np.cumsum(edge) - 1] if len(h) else edge
    return spread(np.concatenate([d[repeats], od]), np.concatenate([p[repeats], op]), buckets)


# ---- the operator ----

def _packed(rows: DataFrame, make, columns: list[str]) -> DataFrame:
    """`make` on every slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n.split()[0], pa.int32() if n.endswith(" int") else pa.binary()) for n in PACKED.split(", ")])
        for batch in batches:
            for part in text_slices(batch, "text", SLICE_BYTES):
                made = list(make(part.column("doc_id").to_numpy(zero_copy_only=False), part.column("text").to_pylist(),
                                 *(part.column(c).to_pylist() for c in columns)))
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=schema)

    return rows.mapInArrow(run, PACKED)


def repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and `places`: packed numbers of the first words of its windows that a document with a smaller number holds as well."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, block = max(1, math.ceil(size / SHARD_BYTES)), (window + 1) // 2

    def blocks(ids, texts):
        return anchor_lists(ids, texts, block, shards)

    def windows(ids, texts, segments):
        return window_lists(ids, texts, segments, window, shards)

    def hits_of(frame):
        return anchor_hits(frame, shards)

    def repeats_of(frame):
        return repeated_windows(frame, shards)

    found = _packed(rows, blocks, []).groupBy("shard").applyInPandas(hits_of, SPREAD)
    hits = cut(found.groupBy("bucket").applyInPandas(gathered, FOUND)).withColumnRenamed("places", "segments")
    near = _packed(rows.join(hits, "doc_id"), windows, ["segments"])
    same = near.groupBy("shard").applyInPandas(repeats_of, SPREAD)
    return cut(same.groupBy("bucket").applyInPandas(gathered, FOUND))


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words that stay, joined by single spaces).

    A word is removed if it lies in a window of `window` consecutive words that also starts in a document with a
    smaller number; windows are judged on the input. Null and empty texts have no words. Rows without a number lose
    nothing and make nobody lose anything. Rows that repeat a number are one document, whose texts are taken as equal.
    An empty table gives an empty result; other columns are not read.
    """
    known = repeats(docs, window, text, doc_id)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(known, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                n_words, n_removed, kept = [], [], []
                for body, starts in zip(part.column("text").to_pylist(), part.column("places").to_pylist()):
                    words = (body or "").encode("utf-8", "surrogatepass").split()
                    n_words.append(len(words))
                    if starts:
                        # +1 where a window starts, -1 behind its end: covered where the sum is positive
                        change = np.zeros(len(words) + window + 1, dtype=np.int64)
                        at = np.frombuffer(starts, dtype="<u4").astype(np.int64)
                        at = at[at + window <= len(words)]
                        change[at] += 1
                        change[at + window] -= 1
                        stays = np.cumsum(change)[: len(words)] == 0
                        words = [words[i] for i in np.flatnonzero(stays).tolist()]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def removal_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, and the SHA-256 of what stays."""
    return remove_repeats(docs, **options).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
