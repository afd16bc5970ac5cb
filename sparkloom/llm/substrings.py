"""Repeated passages by prefix-partitioned suffix trees over words.

A suffix starts at a word. Only suffixes at sampled places are held: a place is
sampled if the hash of its first ``seed`` words is the smallest among those of some
window of ``window`` words, so any two equal windows sample the same place, and
each window is judged at its place.

Prefixes of variable length split the suffixes into groups of bounded size. The
first prefix has ``seed`` words: prefixes that one document alone holds are done
(nothing repeats there), the others' suffixes are dealt to groups by prefix, each
with the words around it that its windows can reach (``window`` to the right,
``window - seed`` to the left). A prefix with more than ``most_suffixes`` suffixes is
lengthened to the whole window: there each window is a suffix of its own, grouped
by a 128-bit hash of its words, and only the smallest document of each is held.

In a group the suffixes are sorted by their words, and the lengths of the prefixes
that neighbours share cut the subtree into nodes: the node of a suffix at depth d is
its run of neighbours that share d words. The same is done with the words to the
left. Suffixes that share a node at depth ``window - l`` and one at depth l to the left
hold the same window; the node's smallest document keeps it, in the others the
window is a repeat, and overlapping windows join into maximal repeats. Words are
compared by their bytes here; hashes only sample and deal.

A task sends each prefix of several documents once, and of equal surroundings
within a slice only those of the smallest document, the others are decided on the
spot. Entries travel as blobs of numbers; how many groups there are follows from
the bytes and suffixes counted, so memory is bounded whatever the input.

Results for odd input: null or empty texts have no word; a null id repeats
nothing and is no one's earlier copy, its row is kept whole and never shuffled; rows
of one id are one document to each other (none repeats the other), also when their
texts differ; repeated rows have repeated results; extra columns are left out; ids
have to be integers (others raise TypeError).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checkpointed, partitions, released
from .words import U, Words, by_bucket, distinct, joined, mix, run_hashes, slices

WINDOW, SEED = 50, 8
#: A prefix with more suffixes is lengthened; groups are dealt to buckets of about GROUP suffixes.
MOST_SUFFIXES, GROUP = 1 << 14, 1 << 15
#: The bound above grows with the input so that at most so many prefixes are lengthened (their hashes go to every task).
MOST_PREFIXES = 1_000_000
#: Entries that a task holds before it sends them.
HELD = 1 << 20
#: Bytes of text to a shuffle partition, and to a bucket of prefixes.
PART_BYTES, BUCKET_BYTES = 64 << 20, 16 << 20

SEEDS = pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("doc", pa.binary()), ("crc", pa.binary()), ("at", pa.binary()), ("n", pa.binary()), ("decided", pa.bool_())])
PLACES = pa.schema([("bucket", pa.int32()), ("doc", pa.binary()), ("crc", pa.binary()), ("at", pa.binary())])
FOUND = pa.schema([("id", pa.int64()), ("crc", pa.int64()), ("at", pa.binary())])
#: kind 0: suffixes with their surroundings; 1: windows by hash; 2: decided
SUFFIXES = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("hash", pa.binary()), ("more", pa.binary()), ("doc", pa.binary()), ("crc", pa.binary()), ("at", pa.binary()), ("end", pa.binary())])
REPEATS = pa.schema([("bucket", pa.int32()), ("doc", pa.binary()), ("crc", pa.binary()), ("at", pa.binary()), ("end", pa.binary())])
#: The crc of rows that name a prefix to be lengthened.
LONGER = -2


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _crcs(texts: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) if x else 0 for x in texts.to_pylist()], np.int64)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values, by doubling."""
    done, low = 1, values
    while done < size:
        step = min(done, size - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    return low


def sampled(w: Words, lane: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the seed, its first word) of each sampled place of the words; the leftmost of equal hashes is taken."""
    n = len(lane)
    starts = np.arange(max(0, n - window + 1))
    starts = starts[starts + window <= w.first[1:][w.text_of[starts]]] if n else starts
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    seeds = run_hashes(lane, seed)
    low = _least(seeds, window - seed + 1)[starts]
    place, open_ = np.empty(len(starts), np.int64), np.arange(len(starts))
    for o in range(window - seed + 1):
        hit = seeds[starts[open_] + o] == low[open_]
        place[open_[hit]] = starts[open_[hit]] + o
        open_ = open_[~hit]
        if not len(open_):
            break
    at = np.unique(place)
    return seeds[at], at


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (first is first), and the number of each sorted entry's run of equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _ends(doc: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest document of each run (run ascends)."""
    if not len(run):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    return np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % U(buckets)).astype(np.int64)


def _rows(schema: pa.Schema, rows: Iterator[tuple], fixed: dict | None = None, names: tuple[str, ...] = ()) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(names or schema.names, r, strict=True)) | (fixed or {}) for r in rows], schema)


def _split(hashes: np.ndarray, doc: np.ndarray, crc: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A task's places: of a seed in several documents here one entry with its count goes on and all places are decided."""
    order, run = _runs(hashes)
    low, high = _ends(doc[order], run)
    several = np.zeros(len(hashes), bool)
    several[order] = (low < high)[run] if len(run) else False
    count = np.bincount(run) if len(run) else run
    first = order[np.flatnonzero(np.r_[True, run[1:] != run[:-1]])] if len(run) else order
    one = first[several[first]]
    n = np.ones(len(hashes), np.int64)
    n[first] = count
    n[~several] = 1
    go = np.r_[np.flatnonzero(~several), one]
    yield _rows(SEEDS, by_bucket((hashes[go] % U(buckets)).astype(np.int64), hashes[go], doc[go], crc[go], at[go], n[go]), {"decided": False}, ("bucket", "hash", "doc", "crc", "at", "n"))
    late = several
    yield _rows(SEEDS, by_bucket(_doc_bucket(doc[late], buckets), doc[late], crc[late], at[late]), {"decided": True}, ("bucket", "doc", "crc", "at"))


def _by_id(table: Iterator[pa.RecordBatch], key: str, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    for whole in table:
        for batch in slices(whole, text):
            yield batch, batch.column(batch.schema.get_field_index(key)).cast(pa.int64()).to_numpy(zero_copy_only=False), batch.column(batch.schema.get_field_index(text))


def _matrix(code: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Row i: 1 + code at start[i], start[i] + step, ...: size[i] of them, then 0."""
    columns = np.arange(width)
    inside = columns < size[:, None]
    return np.where(inside, code[np.where(inside, start[:, None] + step * columns, 0)] + 1, 0).astype(np.uint32)


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of rows (0 ends a row), and how many words each shares with the one before it in that order."""
    order = np.argsort(np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel(), kind="stable")
    s = rows[order]
    same = (s[1:] == s[:-1]) & (s[1:] != 0)
    return order, np.r_[0, np.logical_and.accumulate(same, axis=1).sum(1)].astype(np.int64)


def repeats(code: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes (index) with the words before and after their place that windows of smaller documents cover.

    code: a number for each word; the suffix i starts at code[place[i]], with left[i] words before it and right[i] from it on.
    """
    reach = window - seed
    after, shared = _sorted(_matrix(code, place, right, window, 1))
    before, shared_left = _sorted(_matrix(code, place - 1, left, max(reach, 1), -1))
    low, high = np.full(len(place), reach + 1), np.full(len(place), -1)
    for l in range(reach + 1):  # noqa: E741
        there = np.flatnonzero((left >= l) & (right >= window - l))
        if not len(there):
            continue
        node, node_left = np.empty(len(place), np.int64), np.zeros(len(place), np.int64)
        node[after] = np.cumsum(shared < window - l)
        if l:
            node_left[before] = np.cumsum(shared_left < l)
        order, run = _runs(node[there] * (len(place) + 1) + node_left[there])
        least, _ = _ends(doc[there][order], run)
        hit = there[order][doc[there][order] > least[run]]
        low[hit], high[hit] = np.minimum(low[hit], l), l
    found = np.flatnonzero(high >= 0)
    return found, high[found], window - low[found]


def repeated(documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, carry: tuple[str, ...] = (), most_suffixes: int = MOST_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """(texts, found): texts (id, text, crc, carried) of rows with an id, dealt by (id, crc); found (id, crc, at): pairs of the first word and the word after the last of passages that a smaller id holds too."""
    if not isinstance(documents.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{key} has to be an integer column")
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    buckets, parts = max(2 * partitions(spark), size // BUCKET_BYTES), max(partitions(spark), size // PART_BYTES)
    # a word and what ends it take two bytes at least: no more than MOST_PREFIXES prefixes pass this
    most = max(most_suffixes, size // 2 // MOST_PREFIXES)
    docs = documents.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.struct(*(F.col(c) for c in carry) or (F.lit(0).alias("none"),)).alias("carried"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, ids, texts in _by_id(batches, "id", "text"):
            w = Words(texts)
            h, at = sampled(w, w.digests()[0], window, seed)
            of = w.text_of[at]
            held.append((h, ids[of], _crcs(texts)[of], (at - w.first[:-1][of]).astype(np.int32)))
            n += len(h)
            if n >= HELD:
                yield from _split(*map(np.concatenate, zip(*held, strict=True)), buckets)
                held, n = [], 0
        if n:
            yield from _split(*map(np.concatenate, zip(*held, strict=True)), buckets)
        held.clear()
        released()

    def several(table: pa.Table) -> pa.Table:
        late = table.filter(table["decided"])
        rows = table.filter(pc.invert(table["decided"]))
        h, doc, crc, at, n = (joined(rows[c], k) for c, k in (("hash", np.uint64), ("doc", np.int64), ("crc", np.int64), ("at", np.int32), ("n", np.int64)))
        order, run = _runs(h)
        low, high = _ends(doc[order], run)
        total = np.bincount(run, n[order]) if len(run) else run
        many = np.bincount(run, n[order] > 1) if len(run) else run
        shared = (low < high) | (many > 0)
        keep = order[shared[run] & (n[order] == 1)] if len(run) else order
        longer = np.unique(h[order][(total > most)[run]]).view(np.int64) if len(run) else np.zeros(0, np.int64)
        sent = [_rows(PLACES, by_bucket(_doc_bucket(d, buckets), d, c, a)) for d, c, a in ((doc[keep], crc[keep], at[keep]), (longer, np.full(len(longer), LONGER), np.zeros(len(longer), np.int32)))]
        return pa.Table.from_batches([*sent, *late.select(PLACES.names).cast(PLACES).to_batches()], PLACES)

    def by_document(table: pa.Table) -> pa.Table:
        doc, crc, at = joined(table["doc"], np.int64), joined(table["crc"], np.int64), joined(table["at"], np.int32)
        order, run = _runs(doc, crc, at)
        order = order[np.r_[True, run[1:] != run[:-1]]] if len(run) else order
        doc, crc, at = doc[order], crc[order], at[order]
        limits = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]), True]) if len(doc) else np.zeros(1, np.int64)
        blobs = [at[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:], strict=True)]
        return pa.Table.from_arrays([pa.array(doc[limits[:-1]]), pa.array(crc[limits[:-1]]), pa.array(blobs, pa.binary())], schema=FOUND)

    places = docs.select("id", "text").mapInArrow(seeds, ddl(SEEDS)).repartition(parts, "bucket").groupBy("bucket").applyInArrow(several, ddl(PLACES)).groupBy("bucket").applyInArrow(by_document, ddl(FOUND))
    places = checkpointed(places)
    count = places.where(F.col("crc") >= 0).agg(F.sum(F.octet_length("at") / 4).cast("long").alias("n")).first()["n"] or 0
    long_prefixes = np.array(sorted(r["id"] for r in places.where(F.col("crc") == LONGER).select("id").collect()), np.int64).view(np.uint64)
    long_prefixes.sort()
    groups = max(partitions(spark), -(-count // GROUP))
    texts = docs.select("id", "text", F.crc32(F.col("text").cast("binary")).alias("crc"), "carried").repartition(parts, "id", "crc")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch, ids, part in _by_id(batches, "id", "text"):
            w = Words(part)
            crcs = batch.column(batch.schema.get_field_index("crc")).to_numpy(zero_copy_only=False)
            blobs = [np.frombuffer(b, np.int32) for b in batch.column(batch.schema.get_field_index("at")).to_pylist()]
            of = np.repeat(np.arange(len(blobs)), [len(b) for b in blobs])
            at = np.concatenate(blobs) if blobs else np.zeros(0, np.int32)
            place = at + w.first[:-1][of]
            if len(long_prefixes):
                lanes = w.digests()
                seeds_ = run_hashes(lanes[0], seed)[place]
                long_ = long_prefixes[np.minimum(np.searchsorted(long_prefixes, seeds_), len(long_prefixes) - 1)] == seeds_
                start = (place[long_][:, None] - np.arange(window - seed + 1)).ravel()
                of_ = np.repeat(of[long_], window - seed + 1)
                inside = (start >= w.first[:-1][of_]) & (start + window <= w.first[1:][of_])
                start, of_ = start[inside], of_[inside]
                start, one = np.unique(start, return_index=True)
                of_ = of_[one]
                if len(start):
                    held.append((run_hashes(lanes[0], window)[start], run_hashes(lanes[1], window, 1)[start], ids[of_], crcs[of_], (start - w.first[:-1][of_]).astype(np.int32)))
                    n += len(start)
                    if n >= HELD:
                        yield from windows(held)
                        held, n = [], 0
                of, at, place = of[~long_], at[~long_], place[~long_]
            # the words of the slice, each closed by one space
            limits = np.r_[0, np.cumsum(w.ends - w.starts + 1)]
            plain = np.full(limits[-1], 32, np.uint8)
            inner = np.ones(limits[-1], bool)
            inner[limits[1:] - 1] = False
            plain[inner] = w.data[~w._separator]
            left = np.minimum(place - w.first[:-1][of], window - seed)
            right = np.minimum(w.first[1:][of] - place, window)
            raw = plain.tobytes()
            around = [raw[a:b] for a, b in zip(limits[place - left].tolist(), limits[place + right].tolist(), strict=True)]
            bucket = np.array([zlib.crc32(raw[a:b]) for a, b in zip(limits[place].tolist(), limits[place + seed].tolist(), strict=True)], np.int64) % groups
            doc, crc = ids[of], crcs[of]
            first: dict[tuple[int, bytes], int] = {}
            for key_, d in zip(zip(left.tolist(), around, strict=True), doc.tolist(), strict=True):
                if first.setdefault(key_, d) > d:
                    first[key_] = d
            least = np.array([first[k] for k in zip(left.tolist(), around, strict=True)], np.int64)
            go = np.flatnonzero(doc == least)
            order = go[np.argsort(bucket[go], kind="stable")]
            cut = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True]) if len(order) else [0]
            yield _rows(SUFFIXES, ((int(bucket[order[a]]), b"".join([around[i] for i in order[a:b]]), *(x[order[a:b]].tobytes() for x in (left.astype(np.int16), right.astype(np.int16), doc, crc, at))) for a, b in zip(cut[:-1], cut[1:], strict=True)), {"kind": 0}, ("bucket", "words", "left", "right", "doc", "crc", "at"))
            late = doc > least
            yield decided(doc[late], crc[late], (at - left)[late], (at + right)[late])
        if n:
            yield from windows(held)
        held.clear()
        released()

    def decided(doc: np.ndarray, crc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        return _rows(SUFFIXES, by_bucket(_doc_bucket(doc, buckets), doc, crc, start.astype(np.int32), end.astype(np.int32)), {"kind": 2}, ("bucket", "doc", "crc", "at", "end"))

    def windows(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Windows of lengthened prefixes: those of the smallest document here go on."""
        h, more, doc, crc, at = map(np.concatenate, zip(*held, strict=True))
        order, run = _runs(h, more)
        least = np.empty(len(h), np.int64)
        least[order] = _ends(doc[order], run)[0][run]
        go, late = doc == least, doc > least
        yield _rows(SUFFIXES, by_bucket((h[go] % U(groups)).astype(np.int64), h[go], more[go], doc[go], crc[go], at[go]), {"kind": 1}, ("bucket", "hash", "more", "doc", "crc", "at"))
        yield decided(doc[late], crc[late], at[late], at[late] + window)

    def subtrees(table: pa.Table) -> pa.Table:
        kind = table["kind"][0].as_py() if table.num_rows else 2
        if kind == 2:
            return table.select(REPEATS.names).cast(REPEATS)
        doc, crc, at = joined(table["doc"], np.int64), joined(table["crc"], np.int64), joined(table["at"], np.int32)
        if kind == 1:
            h, more = joined(table["hash"], np.uint64), joined(table["more"], np.uint64)
            order, run = _runs(h, more)
            i = order[doc[order] > _ends(doc[order], run)[0][run]]
            start, end = at[i], at[i] + np.int32(window)
        else:
            data = joined(table["words"], np.uint8)
            left, right = (joined(table[c], np.int16).astype(np.int64) for c in ("left", "right"))
            stops = np.flatnonzero(data == 32)
            code, _ = distinct(data[data != 32], np.r_[0, stops - np.arange(len(stops))])
            place = np.cumsum(left + right) - right
            i, back, ahead = repeats(code, place, left, right, doc, window, seed)
            start, end = at[i] - back, at[i] + ahead
        rows = by_bucket(_doc_bucket(doc[i], buckets), doc[i], crc[i], start.astype(np.int32), end.astype(np.int32))
        return pa.Table.from_batches([_rows(REPEATS, rows)], REPEATS)

    def passages(table: pa.Table) -> pa.Table:
        doc, crc, at, end = (joined(table[c], k) for c, k in (("doc", np.int64), ("crc", np.int64), ("at", np.int32), ("end", np.int32)))
        order = np.lexsort((at, crc, doc))
        doc, crc, both = doc[order], crc[order], np.stack([at[order], end[order]], 1)
        limits = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]), True]) if len(doc) else np.zeros(1, np.int64)
        blobs = [both[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:], strict=True)]
        return pa.Table.from_arrays([pa.array(doc[limits[:-1]]), pa.array(crc[limits[:-1]]), pa.array(blobs, pa.binary())], schema=FOUND)

    entries = texts.join(places, ["id", "crc"]).select("id", "text", "crc", "at").mapInArrow(suffixes, ddl(SUFFIXES))
    found = entries.repartition(groups, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(subtrees, ddl(REPEATS)).groupBy("bucket").applyInArrow(passages, ddl(FOUND))
    return texts, found


def spans(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Maximal repeats from passages (first word, word after the last), in any order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs.reshape(-1, 2).tolist()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED, carry: tuple[str, ...] = (), texts_too: bool = False, most_suffixes: int = MOST_SUFFIXES) -> DataFrame:
    """Per document: key, n_words, n_removed, kept_sha256, spans, the columns in carry; with texts_too also kept, the text without its repeats.

    kept is the text itself where nothing was removed, else the words left,
    joined by one space; kept_sha256 is always of the words so joined.
    """
    texts, found = repeated(documents, key, text, window, seed, carry, most_suffixes)
    rows = texts.join(found, ["id", "crc"], "left").select("id", "text", "at", "carried")
    # rows without an id need no partner
    alone = documents.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("binary").alias("at"), F.struct(*(F.col(c) for c in carry) or (F.lit(0).alias("none"),)).alias("carried"))
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                out: list[list] = [[], [], [], [], []]
                for body, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    words = body.encode().split()  # at the same six bytes as the contract's pattern
                    n, cuts = len(words), spans(np.frombuffer(blob or b"", np.int32))
                    for a, b in reversed(cuts):
                        del words[a:b]
                    kept = b" ".join(words)
                    for column, x in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), cuts, (kept.decode() if cuts else body) if texts_too else None), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array([[{"start": a, "end": b} for a, b in s] for s in out[3]], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(out[4], pa.string()), batch.column(3)], names=["id", "n_words", "n_removed", "kept_sha256", "spans", "kept", "carried"])

    schema = f"id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept string, carried {rows.schema['carried'].dataType.simpleString()}"
    result = rows.mapInArrow(run, schema).unionByName(alone.mapInArrow(run, schema))
    return result.select(F.col("id").cast(kind).alias(key), "n_words", "n_removed", "kept_sha256", "spans", *(["kept"] if texts_too else []), *(F.col("carried")[c].alias(c) for c in carry))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM h) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM r),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""
