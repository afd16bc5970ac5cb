"""How the sources of a language differ in their terms, from mergeable radix tries.

A task counts the terms of its documents in a radix trie over bytes. The trie is held
depth first: leaves stand in the order of their bytes (that of UTF-8), and the edge to a
leaf leaves the path to the leaf before it at the depth that both share, so leaves and
depths are all there is to its branches. Counters belong to (leaf, source): occurrences
for each (lang, source), documents for each lang. Tries are merged by putting their
leaves in one order and adding the counters of equal leaves; slices of a task's input
are merged so, and then the tasks' tries by prefix range: a task's trie is cut at the
limits of ranges, and a piece is written as its edges (depth and bytes). The walk of a
range's merged trie gives the terms that enough documents of a language hold, in order.
What comes next needs only those: a walk's terms, a few thousand at a time, give each
pair of sources its share of the sum of differences, and each source the highest
differences, ties by the order in which the walk meets them.

Limits of ranges are spread evenly over the different terms of a sample of documents;
they decide where a term is merged, not what is counted. Sources of a language are taken
in blocks of ``BLOCK``; a pair of blocks meets each range, so no task holds more than two
blocks of counters for the terms of a piece. A frequent term or a hot source is one leaf
or one counter of each task's trie, however many rows it has.

Arithmetic is exact: counts are whole numbers, and shares are divided digit by digit
(three at a time), so that no product exceeds 64 bits below 9e15 terms a group.

Results for odd input: null text, lang and source are read as ''; a text without terms
still makes its group occur; a language without frequent terms has pairs of value 0;
equal texts and rows of one id count each; keys aren't read; other columns are left out,
whatever their names; empty tables give empty results; a text or a term is held by
itself however long it is.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, partitions, released
from .words import U, Words, mix, slices

LEAST_DOCUMENTS, TOP, SCALE, ADDED = 30, 50, 1_000_000_000, 5
#: Bytes of terms: letters, and all of non-ASCII characters.
LETTER = np.array([chr(i).isalpha() if i < 128 else True for i in range(256)])
#: A task's trie is sent when it has so many leaves or counters; pieces that are sent at once.
LEAVES, COUNTERS, PIECES_AT_ONCE = 1 << 19, 1 << 21, 512
#: Documents looked at for the limits of ranges; different terms of them that are held; terms to a range, at most ranges.
SAMPLE, HELD_TERMS, RANGE_TERMS, MOST_RANGES, LIMIT_BYTES = 1 / 64, 1 << 14, 1 << 12, 1 << 16, 32
#: Bytes of text that are counted at once; a depth beyond which no more is shared.
SLICE, DEEPEST = 4 << 20, 0xFFFF
#: Sources in a block, terms in a piece, matrices of sums held in a task.
BLOCK, PIECE, HELD_SUMS = 128, 1 << 12, 256

PIECES = "range int, langs array<string>, sources array<string>, shared binary, sizes binary, edges binary, n binary, which binary, count binary"
FREQUENT = "range int, lang string, sources array<string>, terms array<string>, total binary, n binary, which binary, count binary, n_terms long, sums array<long>"


class Trie:
    """Leaves in the order of their bytes, and counters (place of the leaf, group, count) by place, each place and group once."""

    def __init__(self, terms: pa.LargeBinaryArray, place: np.ndarray, group: np.ndarray, count: np.ndarray):
        self.terms, self.place, self.group, self.count = terms, place, group, count

    @classmethod
    def merged(cls, parts: list[Trie | tuple]) -> Trie:
        """One trie of tries, or of terms with counters in any order (as the arguments of a trie)."""
        if not parts:
            return cls(pa.array([], pa.large_binary()), *(np.zeros(0, np.int64),) * 3)
        parts = [(p.terms, p.place, p.group, p.count) if isinstance(p, Trie) else p for p in parts]
        whole = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        order = pc.sort_indices(whole.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = rank[whole.indices.to_numpy(zero_copy_only=False)]
        start = np.cumsum([0, *(len(p[0]) for p in parts)])
        place = np.concatenate([code[a + p[1]] for a, p in zip(start, parts, strict=False)])
        group, count = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        groups = int(group.max(initial=0)) + 1
        key = place * groups + group
        by = np.argsort(key, kind="stable")
        key = key[by]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        total = np.add.reduceat(count[by], at) if len(at) else np.zeros(0, np.int64)
        return cls(whole.dictionary.take(pa.array(order)), key[at] // groups, key[at] % groups, total)

    def limits(self, begins: list[bytes]) -> list[int]:
        """The first leaf of each range, and the number of leaves."""
        return [0, *(bisect_left(range(len(self.terms)), b, key=lambda i: self.terms[i].as_py()) for b in begins), len(self.terms)]

    def edges(self, a: int, b: int) -> tuple[bytes, bytes, bytes]:
        """Leaves a to b as depths at which their edges leave the path before, sizes, and bytes of the edges."""
        offsets = np.frombuffer(self.terms.buffers()[1], np.int64)[self.terms.offset :][a : b + 1]
        data = np.frombuffer(self.terms.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        start, size = offsets[:-1] - offsets[0], np.diff(offsets)
        shared, same, j = np.zeros(b - a, np.int64), np.arange(1, b - a), 0
        while len(same) and j < DEEPEST:
            same = same[(size[same] > j) & (size[same - 1] > j)]
            same = same[data[start[same] + j] == data[start[same - 1] + j]]
            j += 1
            shared[same] = j
        own = np.arange(len(data)) - np.repeat(start, size) >= np.repeat(shared, size)
        return shared.astype(np.uint16).tobytes(), (size - shared).astype(np.int32).tobytes(), data[own].tobytes()


def leaves(shared: bytes, sizes: bytes, edges: bytes) -> pa.LargeBinaryArray:
    """The terms of a piece, from its edges."""
    at, before, out = 0, b"", []
    for k, n in zip(np.frombuffer(shared, np.uint16).tolist(), np.frombuffer(sizes, np.int32).tolist(), strict=True):
        before = before[:k] + edges[at : at + n]
        at += n
        out.append(before)
    return pa.array(out, pa.large_binary())


class Counted:
    """Tries to be merged; groups are (lang, source), and (lang, None) for documents of the language."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str | None], int] = {}
        self.parts: list = []
        self.held = 0

    def group(self, name: tuple[str, str | None]) -> int:
        return self.groups.setdefault(name, len(self.groups))

    def add(self, terms: pa.LargeBinaryArray, place: np.ndarray, group: np.ndarray, count: np.ndarray) -> bool:
        """Whether what is held has grown too large, also when merged."""
        self.parts.append((terms, place, group, count))
        self.held += len(place)
        if self.held <= COUNTERS:
            return False
        self.parts = [Trie.merged(self.parts)]
        self.held = len(self.parts[0].place)
        return self.held > COUNTERS // 2 or len(self.parts[0].terms) > LEAVES

    def taken(self) -> Trie:
        trie = Trie.merged(self.parts)
        self.parts, self.held = [], 0
        return trie


def divided(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) for whole numbers, by long division with digits of 1000."""
    out, rest = np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64), count.astype(np.int64)
    left = SCALE
    while left > 1:
        step = min(left, 1000)
        rest = rest * step
        out = out * step + rest // total
        rest = rest % total
        left //= step
    return out + 1


def slice_counts(w: Words, group: np.ndarray, lang: np.ndarray, names: int) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a slice, and (term, group, count): occurrences by each text's group, documents by its lang."""
    limits = np.r_[0, np.cumsum(w.ends - w.starts)].astype(np.int64)
    data = np.ascontiguousarray(w.data[~w._separator])
    whole = pa.Array.from_buffers(pa.large_binary(), len(limits) - 1, [None, pa.py_buffer(limits), pa.py_buffer(data)]).dictionary_encode()
    code = whole.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    many = max(1, len(whole.dictionary))
    key, times = np.unique(code * names + group[w.text_of], return_counts=True)
    once = np.unique(w.text_of * many + code)
    key2, docs = np.unique(once % many * names + lang[once // many], return_counts=True)
    key, times = np.r_[key, key2], np.r_[times, docs].astype(np.int64)
    return whole.dictionary, key // names, key % names, times


def _rows(documents: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return documents.select(named(text).alias("text"), named(lang).alias("lang"), named(source).alias("source"))


def limits(rows: DataFrame) -> list[bytes]:
    """Prefixes at which ranges begin, spread evenly over the different terms of a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def lowest() -> None:
            for t in sorted(held, key=held.get)[HELD_TERMS:]:
                del held[t]

        for whole in batches:
            for batch in slices(whole, "text"):
                w = Words(batch.column(0), lower=True, letters=LETTER)
                known = w.coded()[1]
                digest = np.array([hash_of(t) for t in known], np.uint64)
                held |= dict(zip(known, (mix(digest) >> U(1)).tolist(), strict=True))
                if len(held) > 4 * HELD_TERMS:
                    lowest()
        lowest()
        yield pa.RecordBatch.from_arrays([pa.array(held.values(), pa.int64()), pa.array([t[:LIMIT_BYTES] for t in held], pa.binary())], names=["h", "t"])

    found = rows.sample(SAMPLE, 7).select("text").mapInArrow(run, "h long, t binary").distinct().orderBy("h", "t").limit(HELD_TERMS).collect()
    if not found:
        return []
    # as many different terms as hashes up to the highest one held let expect, in a corpus 1 / SAMPLE times as large at most
    terms = len(found) if len(found) < HELD_TERMS else len(found) * 2**63 // max(1, found[-1]["h"])
    wanted = min(MOST_RANGES, max(4 * partitions(rows.sparkSession), int(terms / SAMPLE) // RANGE_TERMS))
    ordered = sorted({bytes(r["t"]) for r in found})
    return sorted({ordered[i * len(ordered) // wanted] for i in range(1, wanted)})


def hash_of(term: bytes) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(term, digest_size=8).digest(), "big")


def counted(rows: DataFrame, begins: list[bytes]) -> DataFrame:
    """Pieces of each task's trie, by prefix range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counted()

        def sent() -> Iterator[pa.RecordBatch]:
            trie, names, out = held.taken(), list(held.groups), []
            at = trie.limits(begins)
            cut = np.searchsorted(trie.place, at)
            for number in range(len(at) - 1):
                if at[number] == at[number + 1]:
                    continue
                here = slice(cut[number], cut[number + 1])
                used, which = np.unique(trie.group[here], return_inverse=True)
                n = np.bincount(trie.place[here] - at[number]).astype(np.int32)
                out.append((number, [names[g][0] for g in used], [names[g][1] for g in used], *trie.edges(at[number], at[number + 1]), n.tobytes(), which.astype(np.int32).tobytes(), trie.count[here].tobytes()))
                if len(out) == PIECES_AT_ONCE:
                    yield _batch(out, PIECES)
                    out = []
            yield _batch(out, PIECES)

        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                w = Words(batch.column(0), lower=True, letters=LETTER)
                langs, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                group = np.array([held.group(x) for x in zip(langs, sources, strict=True)], np.int64)
                lang = np.array([held.group((x, None)) for x in langs], np.int64)
                if held.add(*slice_counts(w, group, lang, len(held.groups))):
                    yield from sent()
        yield from sent()
        released()

    return rows.mapInArrow(run, PIECES)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    columns = [x.split(" ") for x in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(columns)], names=[name for name, _ in columns])


def merged(pieces: DataFrame, least: int) -> DataFrame:
    """Terms of each range and lang that at least ``least`` documents hold, with counters by source, in the order of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = Counted(), None

        def sent() -> Iterator[pa.RecordBatch]:
            trie, names, out = held.taken(), list(held.groups), []
            for name in sorted({lang for lang, _ in names}):
                frequent = trie.place[(trie.group == held.groups[name, None]) & (trie.count >= least)]
                own = [i for i, (lang, source) in enumerate(names) if lang == name and source is not None]
                of = np.full(len(names), -1)
                of[own] = np.arange(len(own))
                for i in range(0, len(frequent), PIECE):
                    chosen = frequent[i : i + PIECE]
                    here = np.searchsorted(chosen, trie.place).clip(max=len(chosen) - 1)
                    mine = (chosen[here] == trie.place) & (of[trie.group] >= 0)
                    row, which, c = here[mine], of[trie.group[mine]], trie.count[mine]
                    total, sums = np.zeros(len(chosen), np.int64), np.zeros(len(own), np.int64)
                    np.add.at(total, row, c)
                    np.add.at(sums, which, c)
                    n = np.bincount(row, minlength=len(chosen)).astype(np.int32)
                    terms = trie.terms.take(pa.array(chosen)).cast(pa.large_string()).to_pylist()
                    out.append((now, name, [names[g][1] for g in own], terms, total.tobytes(), n.tobytes(), which.astype(np.int32).tobytes(), c.tobytes(), len(chosen), sums.tolist()))
            held.groups.clear()
            yield _batch(out, FREQUENT)

        for batch in batches:
            for r in batch.to_pylist():
                if now is not None and r["range"] != now:
                    yield from sent()
                now = r["range"]
                group = np.array([held.group(x) for x in zip(r["langs"], r["sources"], strict=True)], np.int64)
                n = np.frombuffer(r["n"], np.int32)
                held.add(leaves(r["shared"], r["sizes"], r["edges"]), np.repeat(np.arange(len(n)), n), group[np.frombuffer(r["which"], np.int32)], np.frombuffer(r["count"], np.int64))
        if now is not None:
            yield from sent()
        released()

    # a task has its ranges one after another
    return pieces.repartition(partitions(pieces.sparkSession), "range").sortWithinPartitions("range").mapInArrow(run, FREQUENT)


def blocks(groups: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, i, j, v, lang_total, a, a_total, b, b_total): pairs of blocks of a lang's sources, i <= j, with their sums of counts."""
    sums = frequent.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("total"))
    known = groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    each = known.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    each = each.join(frequent.groupBy("lang").agg(F.sum("n_terms").alias("v")), "lang", "left").select("lang", "lang_total", F.coalesce("v", F.lit(0)).alias("v"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    block = known.withColumn("i", F.floor(place / BLOCK).cast("int")).groupBy("lang", "i").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("s"))
    one = block.select("lang", "i", F.col("s.source").alias("a"), F.col("s.total").alias("a_total"))
    other = block.select("lang", F.col("i").alias("j"), F.col("s.source").alias("b"), F.col("s.total").alias("b_total"))
    return one.join(other, "lang").where("i <= j").join(each, "lang")


def differences(frequent: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """(lang, source, part, item, value): shares of the sums of pairs, and candidates for the highest terms, of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        named: dict[tuple, tuple[list[str], list[str]]] = {}
        best: dict[tuple[str, str], list[tuple[int, bytes]]] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "part", "item", "value"])

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, i, j), found in sums.items():
                a, b = named[lang, i, j]
                # both directions; a block with itself holds both already
                yield out([(lang, x, "pair", y, int(found[m, k])) for m, x in enumerate(a) for k, y in enumerate(b) if x != y])
                if i != j:
                    yield out([(lang, y, "pair", x, int(found[m, k])) for m, x in enumerate(a) for k, y in enumerate(b)])
            sums.clear()
            named.clear()

        for batch in batches:
            for r in batch.to_pylist():
                key, v = (r["lang"], r["i"], r["j"]), r["v"]
                # counters of the piece, by term and source of either block
                row = np.repeat(np.arange(len(r["terms"])), np.frombuffer(r["n"], np.int32))
                which, count = np.frombuffer(r["which"], np.int32), np.frombuffer(r["count"], np.int64)

                def shares(names: list[str], totals: list[int]) -> tuple[np.ndarray, np.ndarray]:
                    of = {s: k for k, s in enumerate(names)}
                    to = np.array([of.get(s, -1) for s in r["sources"]], np.int64)[which]  # noqa: B023
                    c = np.zeros((len(r["terms"]), len(names)), np.int64)  # noqa: B023
                    c[row[to >= 0], to[to >= 0]] = count[to >= 0]  # noqa: B023
                    return c, divided(c + ADDED, np.array(totals, np.int64) + ADDED * v)  # noqa: B023

                c, p = shares(r["a"], r["a_total"])
                q = p if r["i"] == r["j"] else shares(r["b"], r["b_total"])[1]
                found = np.stack([np.abs(p[:, [k]] - q).sum(axis=0) for k in range(p.shape[1])])
                sums[key] = sums[key] + found if key in sums else found
                named[key] = r["a"], r["b"]
                if r["i"] == r["j"]:
                    own = divided(np.frombuffer(r["total"], np.int64) + ADDED, np.array(r["lang_total"] + ADDED * v))
                    for k, source in enumerate(r["a"]):
                        value = p[:, k] - own
                        at = np.flatnonzero((c[:, k] > 0) & (value > 0))
                        # the walk's order breaks ties
                        at = at[np.argsort(-value[at], kind="stable")[:top]]
                        new = [(-int(value[x]), r["terms"][x].encode()) for x in at]
                        best[r["lang"], source] = sorted(best.get((r["lang"], source), []) + new)[:top]
                if len(sums) > HELD_SUMS:
                    yield from sent()
        yield from sent()
        yield out([(lang, source, "term", t.decode(), -x) for (lang, source), found in best.items() for x, t in found])
        released()

    # every piece of a lang meets every pair of its blocks; range is part of the key, as a lang may hold most rows
    places = frequent.select("lang", "range").distinct()
    met = frequent.join(places.join(pairs, "lang"), ["lang", "range"])
    return met.select("lang", "i", "j", "v", "lang_total", "a", "a_total", "b", "b_total", "sources", "terms", "total", "n", "which", "count").mapInArrow(run, "lang string, source string, part string, item string, value long")


def audit(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """Per (lang, source): lang, source, part (pair or term), item, value, rank."""
    rows = _rows(documents, text, lang, source)
    groups = rows.select("lang", "source").distinct()
    frequent = checkpointed(merged(counted(rows, limits(rows)), least))
    pairs = checkpointed(blocks(groups, frequent))
    found = differences(frequent, pairs, top)
    every = pairs.select("lang", F.explode("a").alias("source"), "b").select("lang", "source", F.lit("pair").alias("part"), F.explode("b").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    every = every.unionByName(every.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    summed = found.where("part = 'pair'").unionByName(every).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = found.where("part = 'term'").withColumn("rank", ranked).where(F.col("rank") <= top)
    return summed.withColumn("rank", ranked).unionByName(terms)


#: The same for DuckDB: every group with every frequent term of its language.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (
  SELECT i, lang, source, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM (SELECT i, lang, source, unnest(w) AS x FROM d)
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), g AS (
  SELECT lang, source, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = x.lang AND c.source = x.source) AS total FROM (SELECT DISTINCT lang, source FROM d) x
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.v) AS p
  FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), q AS (
  SELECT x.lang, x.term, 1 + (1000000000::HUGEINT * (x.n + 5)) // (y.total + 5 * v.v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) x JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) y ON x.lang = y.lang JOIN v ON v.lang = x.lang
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
