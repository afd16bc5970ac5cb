"""Packing documents into sequences of a fixed window by non-negative least squares.

Documents are tokenized and closed by an end id. Whole windows are cut off as
sequences of their own; what is left of each document (shorter than a window)
is packed: lengths are counted in steps of ``step`` tokens, shallow combinations
of lengths that fill a window exactly are enumerated, and non-negative least
squares finds how often each is to be used so that the histogram of lengths is
used up. Counts are rounded down, pieces are dealt to the combinations, and the
residual is packed greedily: the longest piece that fits goes in, and where none
fits, one is cut. What no window is full of ends in sequences of powers of two.

Packing runs within groups of documents as they are read, at most
``group_rows`` in a group, so nothing is shuffled and memory is bounded by the
group; a group's histogram holds all its documents. Sequence ids are
(partition, group, number in the group). They are the same on every run over
the same files.

Results for odd input: a null text counts as empty, an empty one is the end id
alone; a null key stays null; repeated rows are packed each; an empty table
gives no rows; extra columns are left out.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import released
from .words import distinct, ranges, slices

WINDOW = 1024
STEP = 8
DEPTH = 3
GROUP_ROWS = 32768
GROUP_TOKENS = 64 << 20
END_ID = 0
#: Bytes of text that are encoded at a time.
SLICE = 2 << 20
#: Encoded units are kept for the life of a worker, at most so many.
CACHED_UNITS = 400_000


def combinations(total: int, depth: int) -> list[tuple[int, ...]]:
    """Descending lists of at most ``depth`` whole numbers from 1 that sum to ``total``."""

    def more(left: int, most: int, depth: int) -> Iterator[tuple[int, ...]]:
        if left <= most:
            yield (left,)
        if depth > 1:
            for x in range(min(most, left - 1), 0, -1):
                if left - x <= x * (depth - 1):
                    yield from ((x, *rest) for rest in more(left - x, x, depth - 1))

    return list(more(total, total, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method on the normal equations."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    small = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= small:
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            part = a[:, p]
            s = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(p)), part.T @ b)
            if s.min() > 0:
                break
            bad = s <= 0
            share = x[p][bad] / np.maximum(x[p][bad] - s[bad], 1e-300)
            x[p] += share.min() * (s - x[p])
            passive[p[(x[p] <= 1e-12)]] = False
            x[~passive] = 0
            if not passive.any():
                s = np.zeros(0)
                p = np.flatnonzero(passive)
                break
        x[:] = 0
        x[p] = s
    return x


_ODD = re.compile(r"\s\s|\s\Z")
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _latin(data: np.ndarray) -> np.ndarray:
    """Bytes of letters, of those up to U+023F; others count as no letters."""
    lead = (data >= 0xC3) & (data <= 0xC8)
    inner = np.zeros(len(data), bool)
    inner[1:] = lead[:-1] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    return _LETTER[data] | lead | inner


class Encoder:
    """Byte-level BPE by units: a word with the space before it is encoded once.

    The tokenizer cuts a text before a space that follows something else than
    white space, and between letters and the marks after them, whatever else the
    text holds, so those are encoded apart, each once in the life of a worker
    (known by its bytes). Texts with runs of white space are encoded whole.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        store = sys.modules.setdefault("_sparkloom_worker", types.ModuleType("_sparkloom_worker")).__dict__
        if path not in store:
            store[path] = types.SimpleNamespace(tokenizer=Tokenizer.from_file(path), keys=None)
        self.store, self.tokenizer = store[path], store[path].tokenizer
        self.end = np.array([end_id], "<u4").tobytes()
        if self.store.keys is None:
            self._forget()

    def _forget(self) -> None:
        # the number of each known piece; limits and ids by number
        self.store.keys = {}
        self.store.ids, self.store.limits = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece in the store; new ones are encoded."""
        store = self.store
        if len(store.keys) + len(pieces) > CACHED_UNITS:
            self._forget()
        number = np.fromiter((store.keys.get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = [pieces[i] for i in new.tolist()]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in fresh], add_special_tokens=False)]
            sizes = list(map(len, ids))
            n = len(store.keys)
            used = int(store.limits[n])
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, sum(sizes))
            while len(store.limits) <= n + len(new):
                store.limits = np.concatenate([store.limits, np.zeros_like(store.limits)])
            while len(store.ids) < used + len(flat):
                store.ids = np.concatenate([store.ids, np.zeros_like(store.ids)])
            store.ids[used : used + len(flat)] = flat
            store.limits[n + 1 : n + 1 + len(new)] = used + np.cumsum(sizes)
            number[new] = np.arange(n, n + len(new))
            store.keys.update(zip(fresh, range(n, n + len(new)), strict=True))
        return number

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without runs of white space."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        limits = np.cumsum([0, *map(len, raw)])
        first = data == 32
        first[limits[:-1][limits[:-1] < len(data)]] = True
        start = np.flatnonzero(first)
        of, units = distinct(data, np.append(start, len(data)))
        own = np.frombuffer(b"".join(units), np.uint8)
        ends = np.cumsum(list(map(len, units)), dtype=np.int64)
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        # marks at the end of a unit whose rest is letters
        base = ends.copy()
        while True:
            cut = (base > starts + 1) & _MARK[own[base - 1]] if len(base) else np.zeros(0, bool)
            if not cut.any():
                break
            base[cut] -= 1
        other = np.r_[0, np.cumsum(~_latin(own))]
        inner = starts + (own[starts] == 32) if len(starts) else starts
        base = np.where((base > inner) & (other[base] == other[inner]), base, ends)
        back, pieces = distinct(own, np.append(np.stack([starts, base], 1).ravel(), len(own)))
        number = self._numbers(pieces)[back]
        store = self.store
        size = store.limits[number + 1] - store.limits[number]
        # ids of distinct units, each of two pieces (the second may be empty), then of all units, one after another
        unit_ids = store.ids[ranges(store.limits[number], size)]
        unit_size = size.reshape(-1, 2).sum(1)
        unit_start = np.cumsum(unit_size) - unit_size
        ids = unit_ids[ranges(unit_start[of], unit_size[of])]
        at = np.r_[0, np.cumsum(unit_size[of])][np.searchsorted(start, limits)]
        return [ids[x:y].tobytes() + self.end for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text and the end id."""
        odd = [i for i, t in enumerate(texts) if _ODD.search(t)]
        skip = set(odd)
        plain = [i for i in range(len(texts)) if i not in skip]
        out = dict(zip(plain, self._plain([texts[i] for i in plain]), strict=True))
        out |= {i: x + self.end for i, x in zip(odd, self._whole([texts[i] for i in odd]), strict=True)}
        return [out[i] for i in range(len(texts))]


def plan(lengths: list[int], window: int = WINDOW, step: int = STEP, depth: int = DEPTH) -> list[list[tuple[int, int, int]]]:
    """Pack pieces of 1 to window - 1 tokens: a list of sequences, each a list of (piece, first token, tokens)."""
    units = window // step
    shapes = combinations(units, depth)
    a = np.zeros((units + 1, len(shapes)))
    for j, shape in enumerate(shapes):
        for u in shape:
            a[u, j] += 1
    by_unit: dict[int, list[int]] = defaultdict(list)
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        by_unit[-(-lengths[i] // step)].append(i)
    histogram = np.array([len(by_unit.get(u, ())) for u in range(units + 1)], float)
    times = nnls(a, histogram)
    out = []
    for j in np.argsort(-times, kind="stable"):
        if times[j] < 1:
            break
        need = {u: int(a[u, j]) for u in set(shapes[j])}
        for _ in range(min(int(times[j]), *(len(by_unit[u]) // k for u, k in need.items()))):
            # the longest of each length class; within a class they differ by less than a step
            out.append([(i, 0, lengths[i]) for u, k in need.items() for i in (by_unit[u].pop() for _ in range(k))])
    left = sorted((lengths[i], i) for pieces in by_unit.values() for i in pieces)
    return out + _greedy([(n, i, 0) for n, i in left], window)


def _greedy(left: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """Fill windows with the longest piece that fits; cut one where none does. left: sorted (tokens, piece, first token)."""
    out, now, free = [], [], window
    while left:
        at = bisect_right(left, (free, 1 << 62, 0)) - 1
        if at >= 0:
            n, i, start = left.pop(at)
            now.append((i, start, n))
            free -= n
        else:
            n, i, start = left.pop(0)
            now.append((i, start, free))
            rest = (n - free, i, start + free)
            left.insert(bisect_right(left, rest), rest)
            free = 0
        if not free:
            out.append(now)
            now, free = [], window
    # the last one is cut into powers of two
    size = window - free
    while size:
        power, taken = 1 << (size.bit_length() - 1), []
        size -= power
        while power:
            i, start, n = now[0]
            use = min(n, power)
            taken.append((i, start, use))
            power -= use
            now[:1] = [(i, start + use, n - use)] if use < n else []
        out.append(taken)
    return out


def pack(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, step: int = STEP, depth: int = DEPTH, group_rows: int = GROUP_ROWS, end_id: int = END_ID) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, serial = Encoder(tokenizer, end_id), TaskContext.get().partitionId() << 40
        keys: list = []
        rests: list[tuple[bytes, int, int]] = []  # ids, start, tokens of the document
        rows: list[list] = [[] for _ in range(7)]
        held = 0

        def add(key, start, ids, tokens, sequence, offset):
            for column, x in zip(rows, (key, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset), strict=True):
                column.append(x)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial, held
            for pieces in plan([len(r[0]) // 4 for r in rests], window, step, depth) if rests else []:
                offset = 0
                for i, first, n in pieces:
                    ids, start, tokens = rests[i]
                    add(keys[i], start + first, ids[4 * first : 4 * (first + n)], tokens, serial, offset)
                    offset += n
                serial += 1
            keys.clear()
            rests.clear()
            held = 0
            yield out()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(rows[0], key_type), *(pa.array(c, pa.int64()) for c in rows[1:])], names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            for c in rows:
                c.clear()
            return batch

        key_type = None
        for whole in batches:
            key_type = whole.schema.field(0).type
            for batch in slices(whole, whole.schema.names[1], SLICE):
                for k, ids in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    tokens = len(ids) // 4
                    full = tokens // window * window
                    for start in range(0, full, window):
                        add(k, start, ids[4 * start : 4 * (start + window)], tokens, serial, 0)
                        serial += 1
                    if full < tokens:
                        keys.append(k)
                        rests.append((ids[4 * full :], full, tokens))
                        held += tokens - full
                    if len(rests) >= group_rows or held >= GROUP_TOKENS:
                        yield from flush()
                    elif len(rows[0]) > 50_000:
                        yield out()
        if key_type is not None:
            yield from flush()
        released()

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
