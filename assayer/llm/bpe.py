"""BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged, so a cut between the two
bytes is certain. The texts are cut there, every fragment is encoded on its own, and the ids are put together again.
A cut is used only where the tokenizer's splitting pattern also starts afresh, whatever stands before it; behind white
space, for example, it does not, because the pattern looks ahead there. Fragments repeat, so a task remembers the
ids of a bounded number of them.

Texts are never shortened; null counts as the empty text. Special tokens written out in a text are encoded as the
tokenizers library does by default. Nothing is shuffled, and only the vocabulary file is sent to the tasks.
"""

from __future__ import annotations

import json
import os
import struct
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

# Worker code travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REMEMBERED_BYTES = 48 << 20  # of fragments and their ids that a task keeps; the table starts anew when it is full
LONGEST_REMEMBERED = 256  # bytes; longer fragments hardly repeat and are encoded each time
OVERHEAD = 250  # bytes that an entry of the table takes besides its own
SLICE_BYTES = 1 << 20  # text encoded at a time

WHITE = tuple(range(0x09, 0x0E)) + (0x20,)
LATIN_LEADS = (0xC3, 0xC4, 0xC5)  # lead bytes of U+00C0 to U+017F, which hold no white space


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the
    other bytes follow from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def token_bytes(tokenizer_json: str) -> list[bytes]:
    """The bytes of every token, by id."""
    spec, byte = json.loads(tokenizer_json), byte_of_char()
    ids = dict(spec["model"]["vocab"])
    ids.update((t["content"], t["id"]) for t in spec["added_tokens"])
    table = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        table[i] = bytes(byte[c] for c in token)
    return table


def certain_cuts(tokens: list[bytes]) -> np.ndarray:
    """cuts[first * 256 + second]: whether to cut between the two bytes.

    The pair occurs inside no token, and the splitting pattern starts afresh at the second byte: the first ends a
    character that is no white space, and the second is no apostrophe that a contraction could start with.
    """
    inside = np.zeros(65536, dtype=bool)
    for token in tokens:
        codes = np.frombuffer(token, dtype=np.uint8).astype(np.int32)
        inside[codes[:-1] * 256 + codes[1:]] = True
    cuts = np.zeros((256, 256), dtype=bool)
    after = [*WHITE, *range(0x21, 0x7F)]
    cuts[0x21:0x7F, after] = True
    cuts[0x80:0xC0, after] = True
    no_letter_or_digit = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()] + list(range(0x80, 0xC0))
    cuts[no_letter_or_digit, ord("'")] = False
    return cuts.reshape(-1) & ~inside


def split_points(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Offsets at which a new fragment starts, without the start of the data."""
    if len(data) < 2:
        return np.zeros(0, dtype=np.int64)
    points = np.flatnonzero(cuts[data[:-1].astype(np.uint16) * np.uint16(256) + data[1:]]) + 1
    # a continuation byte says little about its character; only two-byte Latin letters are known to be safe
    wide = data[points - 1] >= 0x80
    return points[~wide | np.isin(data[np.maximum(points - 2, 0)], LATIN_LEADS)]


class Encoder:
    """Texts to ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_json: str, remembered: int = REMEMBERED_BYTES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cuts = certain_cuts(token_bytes(tokenizer_json))
        self.remembered, self.size, self.known = remembered, 0, {}

    def learn(self, fragments: set[bytes]) -> Iterator[tuple[bytes, bytes]]:
        ordered = list(fragments)
        for at in range(0, len(ordered), 2000):
            some = ordered[at : at + 2000]
            encoded = self.tokenizer.encode_batch_fast([f.decode() for f in some], add_special_tokens=False)
            for fragment, e in zip(some, encoded):
                ids = e.ids
                yield fragment, struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Text i is data[offsets[i]:offsets[i + 1]] in UTF-8."""
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[split_points(data, self.cuts)] = True
        begins[offsets] = True
        starts = np.flatnonzero(begins[:-1])
        raw = data.tobytes()
        fragments = [raw[i:j] for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(raw)])]
        once = {}
        for fragment, packed in self.learn(set(fragments).difference(self.known)):
            cost = len(fragment) + len(packed) + OVERHEAD
            if len(fragment) <= LONGEST_REMEMBERED and self.size + cost <= self.remembered:
                self.known[fragment] = packed
                self.size += cost
            else:
                once[fragment] = packed
        self.known.update(once)
        ids = list(map(self.known.__getitem__, fragments))
        for fragment in once:
            del self.known[fragment]
        if self.size + 2 * OVERHEAD > self.remembered:
            self.known, self.size = {}, 0
        bounds = np.searchsorted(starts, offsets).tolist()
        return [b"".join(ids[a:b]) for a, b in zip(bounds, bounds[1:])]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SLICE_BYTES; a longer text is a piece of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """`keep` and `token_ids`: the ids of the whole text, packed as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. An empty table gives an empty one; columns outside `keep` are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())  # one file of fixed size
    narrow = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for part in slices(batch, "_text"):
                encoder = encoder or Encoder(vocabulary.value)
                ids = encoder.encode(*utf8(part.column("_text")))
                columns = [part.column(c) for c in keep] + [pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "token_ids"])

    return narrow.mapInArrow(run, StructType([*narrow.drop("_text").schema, StructField("token_ids", BinaryType())]))


def texts_of(column: pa.Array, table: list[bytes]) -> pa.Array:
    """The texts that packed ids stand for."""
    texts = []
    for packed in column:
        ids = np.frombuffer(packed.as_py() or b"", dtype="<u4").tolist()
        texts.append(b"".join([table[i] for i in ids]).decode("utf-8", errors="replace"))
    return pa.array(texts, pa.string())


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds `decoded`: the text that the ids in `token_ids` stand for, special tokens included.

    Bytes that are no UTF-8, as a cut list of ids can give, become U+FFFD.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            for part in slices(batch, "token_ids"):
                table = table or token_bytes(vocabulary.value)
                yield part.append_column("decoded", texts_of(part.column("token_ids"), table))

    return encoded.mapInArrow(run, StructType([*encoded.schema, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """`keep`, `token_ids` and `decoded`: what encode and decode give, in one pass through one worker."""
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())
    narrow = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = table = None
        for batch in batches:
            for part in slices(batch, "_text"):
                if encoder is None:
                    encoder, table = Encoder(vocabulary.value), token_bytes(vocabulary.value)
                ids = pa.array(encoder.encode(*utf8(part.column("_text"))), pa.binary())
                columns = [*(part.column(c) for c in keep), ids, texts_of(ids, table)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "token_ids", "decoded"])

    schema = [*narrow.drop("_text").schema, StructField("token_ids", BinaryType()), StructField("decoded", StringType())]
    return narrow.mapInArrow(run, StructType(schema))


def token_digests(docs: DataFrame, tokenizer_path: str, keep: list[str] = ("doc_id",)) -> DataFrame:
    """`keep`, `n_tokens`, and the SHA-256 of the packed ids and of the decoded text."""
    both = round_trip(docs, tokenizer_path, keep=keep)
    return both.select(
        *keep,
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
