"""Packing documents into sequences by cutting-stock column generation.

Every document is encoded once. Its full stretches of `capacity` ids are sequences of their own; what remains is an item
of 1 to capacity - 1 ids. The items' lengths form a histogram, which is grouped into at most CLASSES classes, each as
long as its longest item, so that as little as possible is lost. How many sequences of which pattern (so many items of
each class) cover the histogram is a linear program over all patterns; patterns are generated when their price, found by
knapsack dynamic programming over the dual values, pays. The solution is rounded down and the few items that this leaves
out are placed by first fit. The items of a class are ranked, and ranges of ranks are assigned to the patterns' places.

One document in SPARE is set aside, chosen by a hash of its number. These spare documents are cut freely: their ids, end
to end, fill what the sequences have left, end to end; what is then left of them makes full sequences, and a last one
that is cut into powers of two. So nothing is padded as long as the spare documents fill the gaps.

Only the histogram (fewer than `capacity` rows) and the plan made from it reach the driver. Ranks and running sums are
taken in buckets, so no key holds all rows. Nothing depends on the order of the input but which of equal items goes where.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.llm.ngrams import text_slices
from assayer.llm.workers import kept
from assayer.session import cut

# Worker code travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
END_ID = 1
CLASSES = 96
SPARE = 32
GAP = 1e-3  # of the linear program, against its optimum
GRID = 256  # gaps and spare ids meet within cells of so many ids
REMEMBERED_BYTES = 128 << 20  # a slice of text may go beyond it once
LINES, LINE_WORDS = 64, 128
LONGEST_REMEMBERED = 256
SLICE_BYTES = 4 << 20  # text encoded at a time; a longer text is a slice of its own
LETTERS_END = re.compile(r"[a-z](?=[!-/:-@\[-`{-~])")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
OVERHEAD = 250  # bytes that an entry of a table takes besides its own


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, as the tokenizer has them anyway; only the names of special tokens must not come about by it."""
    low = pa.compute.ascii_lower(texts)
    odd = pa.compute.indices_nonzero(pa.compute.match_substring(texts, "<|")).to_pylist()
    if not odd:
        return low
    out = low.to_pylist()
    for i in odd:
        text = texts[i].as_py()
        if any(out[i].count(t) != text.count(t) for t in SPECIAL):
            out[i] = text
    return pa.array(out, pa.large_string())


def word_parts(word: str) -> tuple[str, ...]:
    """The word, cut before the first mark behind a letter a-z, where a run of letters ends whatever follows."""
    at = LETTERS_END.search(word)
    if at is None or "<|" in word:
        return (word,)
    return word[: at.end()], word[at.end() :]


class WordEncoder:
    """Ids of whole texts.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those of its words, one behind the
    other. The distinct words of many texts are looked up once each and put in place in arrays. Short words are
    remembered, up to REMEMBERED_BYTES in all, from task to task of a worker.
    """

    def __init__(self, tokenizer_json: str, remembered: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.limit, self.size, self.known = remembered, 0, {}
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids start and end)"""
        # copied: ascii_lower misreads the offsets of a slice of a longer array
        texts = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())
        words = pa.compute.ascii_split_whitespace(lowered(texts))
        per_text = pa.compute.list_value_length(words).to_numpy(zero_copy_only=False)
        each = words.flatten().dictionary_encode()
        packed = self._ids(each.dictionary.to_pylist())
        size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        place = each.indices.to_numpy(zero_copy_only=False)
        n = size[place]
        end = np.cumsum(n)
        first = (np.cumsum(size) - size)[place]
        flat = np.frombuffer(b"".join(packed), dtype="<u4")
        ids = flat[np.repeat(first - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        return ids, np.append(0, end)[np.append(0, np.cumsum(per_text))]

    def _ids(self, words: list[str]) -> list[bytes]:
        found = list(map(self.known.get, words))
        missing = [w for w, ids in zip(words, found) if ids is None]
        if not missing:
            return found
        parts = {word: word_parts(word) for word in missing}
        learnt = dict(self._learn(list({p for ps in parts.values() for p in ps}.difference(self.known))))
        learnt.update((word, b"".join([learnt[p] if p in learnt else self.known[p] for p in ps])) for word, ps in parts.items() if len(ps) > 1)
        found = [learnt[w] if ids is None else ids for w, ids in zip(words, found)]
        if self.size < self.limit:  # once full it stays: the words met first are the frequent ones
            short = {w: ids for w, ids in learnt.items() if len(w) <= LONGEST_REMEMBERED}
            self.known.update(short)
            self.size += OVERHEAD * len(short) + sum(map(len, short)) + sum(map(len, short.values()))
        return found

    def _learn(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words with their ids. A line of words is encoded at once; the places of its tokens tell the words apart."""
        for at in range(0, len(words), LINES * LINE_WORDS):
            lines = [words[i : i + LINE_WORDS] for i in range(at, min(at + LINES * LINE_WORDS, len(words)), LINE_WORDS)]
            for line, e in zip(lines, self.tokenizer.encode_batch([" ".join(line) for line in lines], add_special_tokens=False)):
                starts = np.cumsum([0] + [len(w) + 1 for w in line[:-1]])
                places = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
                owner = np.searchsorted(starts, places, side="right") - 1
                ends = (4 * np.cumsum(np.bincount(owner, minlength=len(line)))).tolist()
                packed = np.array(e.ids, dtype="<u4").tobytes()
                yield from zip(line, (packed[i:j] for i, j in zip([0, *ends], ends)))


def encoded(docs: DataFrame, tokenizer_path: str, capacity: int, spare: int, text: str, doc_id: str) -> DataFrame:
    """_row (a number of its own), doc_id, n (ids), crcs (of every `capacity` ids), ids (by `capacity`; of spare documents only)."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    digest = hashlib.md5(tokenizer_json.encode()).hexdigest()
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one file of fixed size
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for part in text_slices(batch, "_text", SLICE_BYTES):
                encoder = encoder or kept(f"words {digest}", lambda: WordEncoder(vocabulary.value))
                n, crcs, ids = [], [], []
                found, bounds = encoder.encode(part.column("_text"))
                found, bounds = memoryview(found.tobytes()), (4 * bounds).tolist()
                for a, b, aside in zip(bounds, bounds[1:], part.column("_aside").to_pylist()):
                    packed = memoryview(bytes(found[a:b]) + struct.pack("<I", END_ID))
                    n.append(len(packed) // 4)
                    crcs.append([zlib.crc32(packed[i : i + step]) for i in range(0, len(packed), step)])
                    ids.append([bytes(packed[i : i + step]) for i in range(0, len(packed), step)] if aside else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())),
                     pa.array(ids, pa.list_(pa.binary()))], names=["_row", "doc_id", "n", "crcs", "ids"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")).withColumn(
        "_row", F.monotonically_increasing_id())
    aside = F.pmod(F.xxhash64(F.coalesce("doc_id", "_row"), F.lit(31)), F.lit(spare)) == 0
    return cut(narrow.select("_row", "doc_id", "_text", aside.alias("_aside")).mapInArrow(
        run, "_row bigint, doc_id bigint, n bigint, crcs array<bigint>, ids array<binary>"))


# ---- the plan: classes of lengths, patterns, how often each is used ----

def length_classes(lengths: np.ndarray, counts: np.ndarray, most: int = CLASSES) -> np.ndarray:
    """The upper ends of at most `most` classes, such that the items, each as long as its class, are shortest in total."""
    m = len(lengths)
    if m <= most:
        return lengths
    items, words = np.append(0, np.cumsum(counts, dtype=float)), np.append(0, np.cumsum(counts * lengths, dtype=float))
    # loss[i, j]: lengths i to j as one class
    loss = lengths[None, :] * (items[None, 1:] - items[:-1, None]) - (words[None, 1:] - words[:-1, None])
    loss[np.tril_indices(m, -1)] = np.inf
    best, back = loss[0].copy(), []
    for _ in range(1, most):
        total = np.append(np.inf, best[:-1])[:, None] + loss
        first = total.argmin(axis=0)
        better = np.minimum(best, total[first, np.arange(m)])
        back.append(np.where(better < best, first, -1))
        best = better
    ends, j = [], m - 1
    for first in reversed(back):
        if first[j] >= 0:  # -1: one class fewer does as well
            ends.append(j)
            j = first[j] - 1
    ends.append(j)
    return lengths[np.array(ends[::-1])]


def best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the multiset of sizes within the capacity that is worth most."""
    worth, steps = np.zeros(capacity + 1), []
    for c in np.flatnonzero(values > 1e-12):
        copies = 1
        while copies * sizes[c] <= capacity:
            size = copies * sizes[c]
            other = worth[:-size] + copies * values[c]
            take = other > worth[size:]
            np.maximum(worth[size:], other, out=worth[size:])
            steps.append((c, copies, size, take))
            copies *= 2
    pattern, room = np.zeros(len(sizes), dtype=np.int64), int(worth.argmax())
    best = float(worth[room])
    for c, copies, size, take in reversed(steps):
        if room >= size and take[room - size]:
            pattern[c] += copies
            room -= size
    return best, pattern


def dense_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """A quick pattern: the sizes worth most for their length first, each as often as it fits."""
    pattern, room, worth = np.zeros(len(sizes), dtype=np.int64), capacity, 0.0
    for c in np.argsort(-values / sizes, kind="stable").tolist():
        if sizes[c] <= room and values[c] > 0:
            pattern[c] = room // sizes[c]
            room -= int(pattern[c] * sizes[c])
            worth += float(pattern[c] * values[c])
            if room < sizes[0]:
                break
    return worth, pattern


def patterns_by_columns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (one a column) and how often the linear program uses each, fractions included.

    Revised simplex from patterns of a single class. A quick pattern enters if it pays, else the knapsack looks for the
    best. With value v of the best pattern no solution is below 1 / v of this one, so it ends within GAP of the optimum;
    every basis on the way covers the demand.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(60 * m):
        price = np.linalg.solve(basis.T, np.ones(m))
        value, pattern = dense_pattern(sizes, price, capacity)
        if value <= 1 + 10 * GAP:
            value, pattern = best_pattern(sizes, price, capacity)
        if value <= 1 + GAP:
            break
        used, step = np.linalg.solve(basis, np.stack([demand, pattern], axis=1).astype(float)).T
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    return basis.round().astype(np.int64), np.maximum(np.linalg.solve(basis, demand.astype(float)), 0)


def packing_plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each: the program rounded down, then first fit by falling length for the rest."""
    if not len(sizes):
        return []
    basis, used = patterns_by_columns(sizes, demand, capacity)
    times = np.floor(used + 1e-6).astype(np.int64)
    plan = [(basis[:, p], int(times[p])) for p in range(len(times)) if times[p]]
    rest = np.maximum(demand - basis @ times, 0)
    while rest.any():
        pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for c in range(len(sizes) - 1, -1, -1):
            pattern[c] = min(rest[c], room // sizes[c])
            room -= pattern[c] * sizes[c]
        repeat = int((rest[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, repeat))
        rest = rest - repeat * pattern
    return plan


# ---- assignment ----

def _buckets(rows: int) -> int:
    return min(4096, max(16, rows >> 16))


def running(rows: DataFrame, key: str, value: Column, name: str, buckets: int, groups: list[str] = ()) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows before, in an order by hash; within groups if there are any.

    Summed in buckets of hashed keys; the buckets' totals, of which there are at most `buckets` a group, come on top.
    """
    dealt = rows.withColumns({"_value": value, "_bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")})
    before = (Window.unboundedPreceding, -1)
    inner = F.sum("_value").over(Window.partitionBy(*groups, "_bucket").orderBy(key).rowsBetween(*before))
    outer = F.sum("_sum").over(Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(*before))
    totals = dealt.groupBy(*groups, "_bucket").agg(F.sum("_value").alias("_sum")).select(
        *groups, "_bucket", F.coalesce(outer, F.lit(0)).alias("_before"))
    return dealt.withColumn("_inner", F.coalesce(inner, F.lit(0))).join(totals, [*groups, "_bucket"]).withColumn(
        name, (F.col("_before") + F.col("_inner")).cast("long")).drop("_value", "_bucket", "_before", "_inner")


def _cells(rows: DataFrame, at: str, length: str) -> DataFrame:
    """One row per cell of GRID ids that the stretch [at, at + length) touches."""
    return rows.withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col(at) / GRID), F.floor((F.col(at) + F.col(length) - 1) / GRID))))


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, classes: int = CLASSES, spare: int = SPARE,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text and id 1; null counts as empty, so every row has an id at least. Each
    id lies in one piece. Rows that repeat a number are documents of their own; the number may be null. A text of any
    length is cut at every `capacity` ids. Sequences have no gaps; their order means nothing. An empty table gives an
    empty result. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = encoded(docs, tokenizer_path, capacity, spare, text, doc_id)
    whole, loose = rows.where("ids is null").drop("ids"), rows.where("ids is not null")
    items = whole.select("_row", "doc_id", "n", F.expr(f"n % {capacity}").alias("length"), F.element_at("crcs", -1).alias("crc")).where("length > 0")

    # fewer than `capacity` rows
    found = sorted((r["length"], r["count"]) for r in items.groupBy("length").count().collect())
    lengths, counts = np.array([x for x, _ in found], dtype=np.int64), np.array([x for _, x in found], dtype=np.int64)
    sizes = length_classes(lengths, counts, classes)
    member = np.searchsorted(sizes, lengths)
    demand = np.bincount(member, weights=counts, minlength=len(sizes)).astype(np.int64)
    plan = packing_plan(sizes, demand, capacity)
    places, taken, sequences = [], Counter(), 0
    for pattern, times in plan:
        for c in np.flatnonzero(pattern).tolist():
            each = int(pattern[c])
            places.append((c, taken[c], taken[c] + each * times, each, sequences))
            taken[c] += each * times
        sequences += times

    buckets = _buckets(int(counts.sum()))
    # both tables are as small as the histogram and the plan
    class_of = spark.createDataFrame(list(zip(lengths.tolist(), member.tolist())), "length bigint, class int")
    place = spark.createDataFrame(places, "class int, low bigint, high bigint, each bigint, first bigint")
    ranked = running(items.join(F.broadcast(class_of), "length"), "_row", F.lit(1), "rank", buckets, ["class"])
    placed = ranked.join(F.broadcast(place), "class").where("rank >= low and rank < high").select(
        "_row", "doc_id", "n", "length", "crc", (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).alias("sequence_id"))
    in_order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut(placed.withColumn("offset", F.coalesce(F.sum("length").over(in_order), F.lit(0)).cast("long")))

    gaps = placed.groupBy("sequence_id").agg(F.sum("length").alias("offset")).select(
        "sequence_id", "offset", (F.lit(capacity) - F.col("offset")).alias("room")).where("room > 0")
    gaps = cut(running(gaps, "sequence_id", F.col("room"), "at", buckets))
    gap_ids = gaps.agg(F.sum("room")).first()[0] or 0

    chunk = F.posexplode("ids").alias("_chunk", "ids")
    chunks = loose.select("_row", "doc_id", "n", chunk).withColumns({
        "_unit": F.struct("_row", "_chunk"), "length": (F.octet_length("ids") / 4).cast("long"), "start": (F.col("_chunk") * F.lit(capacity)).cast("long")})
    chunks = cut(running(chunks, "_unit", F.col("length"), "at", buckets))
    spare_ids = chunks.agg(F.sum("length")).first()[0] or 0

    # what the gaps do not take: full sequences and one for each power of two of the last
    beyond = max(spare_ids - gap_ids, 0)
    full, last = divmod(beyond, capacity)
    tail, at = [], gap_ids + full * capacity
    for bit in range(last.bit_length() - 1, -1, -1):
        if last >> bit & 1:
            tail.append((sequences + full + len(tail), 0, 1 << bit, at))
            at += 1 << bit
    shape = "sequence_id bigint, offset bigint, room bigint, at bigint"
    fresh = spark.range(full).select(
        (F.col("id") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.lit(capacity).cast("long").alias("room"), (F.col("id") * capacity + gap_ids).alias("at"))
    slots = gaps.select("sequence_id", "offset", "room", "at").unionByName(fresh).unionByName(spark.createDataFrame(tail, shape))
    slots = _cells(slots.withColumnRenamed("at", "_at"), "_at", "room")
    low, high = F.greatest("at", "_at"), F.least(F.col("at") + F.col("length"), F.col("_at") + F.col("room"))
    met = _cells(chunks, "at", "length").join(slots, "_cell").withColumns({"_low": low, "_high": high}).where(
        (F.col("_low") < F.col("_high")) & (F.floor(F.col("_low") / GRID) == F.col("_cell")))
    fills = met.select(
        "doc_id", (F.col("start") + F.col("_low") - F.col("at")).alias("start"), (F.col("_high") - F.col("_low")).alias("length"),
        F.crc32(F.expr("substring(ids, int(4 * (_low - at) + 1), int(4 * (_high - _low)))")).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), "sequence_id", (F.col("offset") + F.col("_low") - F.col("_at")).alias("offset"))

    long_ones = whole.withColumn("_full", F.floor(F.col("n") / capacity)).where("_full > 0")
    numbered = running(long_ones, "_row", F.col("_full"), "_first", buckets)
    stretches = numbered.select(
        "doc_id", "n", "_first", F.posexplode(F.slice("crcs", F.lit(1), F.col("_full").cast("int"))).alias("_at", "ids_crc32")).select(
        "doc_id", (F.col("_at") * F.lit(capacity)).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32",
        F.col("n").alias("doc_tokens"), (F.col("_first") + F.col("_at") + F.lit(sequences + full + len(tail))).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    rests = placed.select(
        "doc_id", (F.col("n") - F.col("length")).alias("start"), "length", F.col("crc").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    return stretches.unionByName(rests).unionByName(fills)
