"""Words and word n-grams of a batch of texts, hashed in arrays.

A word is a run of bytes other than space and U+0009 to U+000D, unchanged. Hashes are 64 bits wide and depend on
nothing but the words.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Worker code travels with the query, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 1 << 20  # hashed at a time; bounds the arrays of a very long text

_random = np.random.default_rng(9)
BYTE = _random.integers(0, 2**64, 256, dtype=np.uint64)
PLACE = _random.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
FACTOR = _random.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole 64-bit word (the finishing step of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of several texts, one behind the other.

    `data`: the words joined by single spaces; `starts`, `ends`: where each word lies in it; `counts`: words per text.
    """

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.counts = np.array([len(p) for p in parts], dtype=np.int64)
        self.data = b" ".join([b" ".join(p) for p in parts if p])
        spaces = np.flatnonzero(np.frombuffer(self.data, dtype=np.uint8) == 0x20)
        if self.data:
            self.starts = np.concatenate([[0], spaces + 1])
            self.ends = np.concatenate([spaces, [len(self.data)]])
        else:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])  # index of each text's first word

    def hashes(self) -> np.ndarray:
        """One hash per word: the sum of a random number per byte times one per place."""
        data = np.frombuffer(self.data, dtype=np.uint8)
        out = np.empty(len(self.starts), dtype=np.uint64)
        chunk = self.ends // CHUNK_BYTES
        edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)] if len(chunk) else [0]
        for a, b in zip(edges, edges[1:]):
            s, e = self.starts[a:b], self.ends[a:b]
            if e[-1] - s[0] > 4 * CHUNK_BYTES:  # a word of megabytes
                out[a:b] = [
                    int.from_bytes(hashlib.blake2b(self.data[i:j], digest_size=8).digest(), "little")
                    for i, j in zip(s.tolist(), e.tolist())
                ]
                continue
            # the space behind a word counts with it, so that words tile the range
            size = np.diff(np.append(s, e[-1]))
            place = np.arange(e[-1] - s[0]) - np.repeat(s - s[0], size)
            values = BYTE[data[s[0] : e[-1]]] * PLACE[place & 4095]
            far = place > 4095
            if far.any():
                values[far] *= (place[far] >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            values[data[s[0] : e[-1]] == 0x20] = 0
            out[a:b] = mix(np.add.reduceat(values, s - s[0]))
        return out

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every n consecutive words of one text: the index of the first word, and of the text."""
        per_text = np.maximum(self.counts - n + 1, 0)
        text = np.repeat(np.arange(len(self.counts)), per_text)
        within = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        return self.first[text] + within, text


def ngram_hashes(words: np.ndarray, starts: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of words[i] ... words[i + n - 1] for i in starts."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(n):
        out += words[starts + k] * FACTOR[(k + seed * 16) & 63]
    return mix(out)


def text_slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `size` bytes of text; a longer text is a piece of its own."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes, dtype=np.int64) // size
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
