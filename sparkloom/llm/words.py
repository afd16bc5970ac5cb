"""Vectorised word splitting and hashes of word runs over Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, the same as
``[^\\x20\\x09-\\x0D]+`` on the text, because UTF-8 never uses those bytes
inside a longer character. Words are told apart by their bytes; a word's digest is
BLAKE2b of them (128 bits, as two lanes of 64). A run of words is hashed by a
tree of pairs over its words' digests, each lane by itself, with a mixing step at each
node, so no choice of words cancels out as in a polynomial sum. Hashes don't
depend on batches or on the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
U = np.uint64
#: Factors of a pair's left and right part, by lane.
PAIR = ((0x9FB21C651E98DF25, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise: spreads every input bit over the result."""
    h = h ^ (h >> U(31))
    h = h * U(0x9E3779B97F4A7C15)
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def pair(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of two hashes, in order."""
    return mix(a * U(PAIR[lane][0]) + b * U(PAIR[lane][1]) + U(0x2545F4914F6CDD1D))


def run_hashes(values: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """The hash of each k consecutive values (one for each start): a tree of pairs, put together from powers of two."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, used, level, width = None, 0, values, 1
    while True:
        if k & width:
            part = level[used : used + n]
            out, used = part if out is None else pair(out, part, lane), used + width
        if 2 * width > k:
            return mix(out + U(k))
        level, width = pair(level[:-width], level[width:], lane), 2 * width


def distinct(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Strings that stand one after another, cut at limits: a number for each, and the distinct ones by number."""
    whole = pa.Array.from_buffers(pa.large_binary(), len(limits) - 1, [None, pa.py_buffer(np.ascontiguousarray(limits, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    found = whole.dictionary_encode()
    known = found.dictionary
    at = np.frombuffer(known.buffers()[1], np.int64)[: len(known) + 1].tolist() if len(known) else [0]
    raw = known.buffers()[2].to_pybytes() if len(known) and known.buffers()[2] else b""
    return found.indices.to_numpy(zero_copy_only=False), [raw[a:b] for a, b in zip(at, at[1:])]


class Words:
    """Words of a batch of texts: byte limits and offsets by text; ``letters`` (true by byte) in place of what isn't white space."""

    def __init__(self, texts: pa.Array, lower: bool = False, letters: np.ndarray | None = None):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
        self.data = np.where((data >= 65) & (data <= 90), data | np.uint8(32), data) if lower else data
        separator = (data == 32) | ((data >= 9) & (data <= 13)) if letters is None else ~letters[self.data]
        cut = np.zeros(len(data) + 1, bool)
        cut[self.offsets] = True
        before = np.ones(len(data), bool)
        before[1:] = separator[:-1]
        after = np.ones(len(data), bool)
        after[:-1] = separator[1:]
        self.starts = np.flatnonzero(~separator & (before | cut[:-1]))
        self.ends = np.flatnonzero(~separator & (after | cut[1:])) + 1
        #: words of text i are those from first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(n), self.counts)

        self._separator = separator

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """A number for each word, and the distinct words by number: equal numbers are equal bytes."""
        return distinct(self.data[~self._separator], np.r_[0, np.cumsum(self.ends - self.starts)])

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two lanes of 64 bits for each word."""
        code, known = self.coded()
        both = np.frombuffer(b"".join([blake2b(w, digest_size=16).digest() for w in known]), "<u8").reshape(-1, 2)
        return both[:, 0][code], both[:, 1][code]


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word runs that lie in one text, the index of each one's first word, and the words' own digests (first lane)."""
    values = words.digests()[0]
    at = np.arange(max(0, len(values) - k + 1))
    at = at[at + k <= words.first[1:][words.text_of[at]]] if len(at) else at
    return run_hashes(values, k)[at], at, values


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes; a longer single text is a run by itself."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = total = 0
    for i, x in enumerate(size):
        if i > start and total + x > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += x
    if start < len(size):
        yield batch.slice(start)


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Each bucket that occurs with the bytes of its values in each column."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    limits = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else []
    for a, b in zip(limits[:-1], limits[1:], strict=True):
        yield int(bucket[a]), *(c[a:b].tobytes() for c in columns)


def joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The values of all blobs of a binary column, one after another."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def lists(key: np.ndarray, n: int, values: np.ndarray) -> list[np.ndarray]:
    """values in ``n`` lists by a sorted key of 0 to n - 1."""
    limits = np.searchsorted(key, np.arange(n + 1))
    return [values[a:b] for a, b in zip(limits[:-1], limits[1:], strict=True)]
