"""Size-aware heavy-light join of documents by Jaccard similarity of their shingle sets.

Equal sets are one node (by a 64-bit digest of the set); the join runs over
nodes and gives components, so copies are never made into pairs.

Light sets (up to a boundary size) enumerate fixed-size subsets: two sets of a
and b shingles are similar if they share ceil(p (a + b) / (100 + p)) of them, so
each light set files all its subsets of that size for every partner size, and
meeting subsets (by 128-bit keys) are links, held against the sets once more.

Heavy sets (and those near the boundary, which may have a heavy partner) scan
inverted lists. A first scan holds the shingles with the smallest hashes only:
similar sets share a stated number of those, so a set that shares fewer with all
others is done. For the rest (few) the lists of all their shingles are counted;
with shingles ordered from rare to frequent, similar sets share one of the first
n - ceil(p n / 100) + 1, and lists of those prefixes join candidates to groups
by their smallest member. Groups are verified exactly on whole sets: first each set
against the group's smallest one; the sets near that are one component, and what is
left meets them and itself in tiles of two blocks of bounded size, by products of
incidence matrices; a tile gives a spanning forest of its links.

The boundary is where estimated subsets plus list entries are fewest, from the
histogram of sizes.

Results for odd input: null, empty and blank texts have an empty set, are linked
with nothing and are their own component; documents with fewer words than a
shingle have their whole sequence as their only shingle; a null id is in the
component of its text but never names it (a component of null ids only is null);
rows of one id count as they are, each by its own text; an empty table gives an
empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, connected, forest, partitions, released
from .words import U, Words, by_bucket, grams, joined, mix, run_hashes, slices

#: Sets up to this size may be light; they travel with the table of nodes.
LIGHT_MOST = 32
#: The share of a set that the first scan demands besides the prefix.
DEMAND = 10
#: A tile's block: rows and shingles at most (a single set may be larger).
BLOCK_ROWS, BLOCK_SHINGLES = 512, 2_000_000
COLUMNS = 4096
#: Hashes of wanted texts (8 bytes each) are broadcast up to this many; beyond, all texts are shuffled to meet them.
FEW_TEXTS = 500_000


def least(n, percent: int):
    """ceil(percent n / 100): the smallest partner, and the smallest overlap, of a set of n shingles."""
    return -(-(percent * n) // 100)


def overlap(a: int, b: int, percent: int) -> int:
    return -(-(percent * (a + b)) // (100 + percent))


def demand(n):
    return -(-n // DEMAND)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of every distinct shingle, sorted, and the number of shingles of each text."""
    w = Words(texts, lower=True)
    h, at, values = grams(w, k)
    of = w.text_of[at]
    for n in range(1, k):
        short = np.flatnonzero(w.counts == n)
        if len(short):
            h, of = np.r_[h, run_hashes(values, n)[w.first[short]]], np.r_[of, short]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return of, h, np.bincount(of, minlength=len(texts)).astype(np.int64)


def digests(of: np.ndarray, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A digest of each text's set."""
    sums = np.zeros(len(counts), np.uint64)
    there = counts > 0
    limits = np.cumsum(counts) - counts
    if len(h):
        sums[there] = np.add.reduceat(mix(h ^ U(0x9E6C63D0876A3F35)), limits[there])
    return mix(sums + counts.astype(np.uint64) * U(0xA0761D6478BD642F)).view(np.int64)


def nodes_of(documents: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """(id, text_hash, n, node, small, low): the set's size and digest; its shingles if it may be light; its smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.names[1]):
                of, h, n = shingles(batch.column(1), k)
                start, size = (np.cumsum(n) - n).tolist(), n.tolist()
                small = [h[a : a + c].tobytes() if 0 < c <= LIGHT_MOST else None for a, c in zip(start, size, strict=True)]
                low = [h[a : a + c].tobytes() for a, c in zip(start, (n - least(n, percent) + demand(n)).tolist(), strict=True)]  # a set's hashes are sorted
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(digests(of, h, n)), pa.array(small, pa.binary()), pa.array(low, pa.binary())], names=["id", "text_hash", "n", "node", "small", "low"])
        released()

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, f"id {kind}, text_hash long, n long, node long, small binary, low binary")


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest light size, at the least estimated cost."""

    def subsets(a: int, most: int) -> int:
        return sum(comb(a, o) for b in range(least(a, percent), min(most, 100 * a // percent) + 1) if (o := overlap(a, b, percent)) <= min(a, b))

    def cost(x: int) -> int:
        light = sum(c * subsets(a, x) for a, c in sizes.items() if 0 < a <= x)
        heavy = sum(c * (a - least(a, percent) + demand(a) + a // 4) for a, c in sizes.items() if a >= least(x + 1, percent))
        return light + heavy

    return min(range(LIGHT_MOST + 1), key=lambda x: (cost(x), x))


def light_links(nodes: DataFrame, most: int, percent: int) -> DataFrame:
    """Links (u, v) among sets of up to ``most`` shingles: a star around the smallest node of each shared subset.

    A subset's key is 128 bits; each link is held against the sets themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            n_all = batch.column(1).to_numpy(zero_copy_only=False)
            node_all = batch.column(0).to_numpy(zero_copy_only=False)
            blobs = batch.column(2)
            for a in np.unique(n_all).tolist():
                rows = np.flatnonzero(n_all == a)
                sets = np.frombuffer(b"".join(blobs[int(i)].as_py() for i in rows), np.uint64).reshape(-1, a)
                lanes = [mix(sets ^ U(c)) for c in (0x2545F4914F6CDD1D, 0xA24BAED4963EE407)]
                for b in range(least(a, percent), min(most, 100 * a // percent) + 1):
                    o = overlap(a, b, percent)
                    if o > min(a, b):
                        continue
                    gone = np.array(list(combinations(range(a), a - o)), np.int64).reshape(comb(a, o), a - o)
                    sizes = U(min(a, b) * 1_000_003 + max(a, b))
                    for i in range(0, len(rows), 4096):
                        for column, lane in zip(out, lanes, strict=False):
                            part = lane[i : i + 4096]
                            left = part.sum(1, dtype=np.uint64)[:, None] - part[:, gone].sum(2, dtype=np.uint64)
                            column.append(mix(left + sizes).ravel().view(np.int64))
                        out[2].append(np.repeat(node_all[rows[i : i + 4096]], len(gone)))
                        out[3].append(np.full(left.size, a))
                        out[4].append(np.full(left.size, a == b))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["key", "more", "node", "n", "same"])

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    light = nodes.where(F.col("n").between(1, most)).select("node", "n", "small")
    filed = light.mapInArrow(run, "key long, more long, node long, n long, same boolean").distinct()
    stars = filed.groupBy("key", "more").agg(F.min("node").alias("hub"), F.max("node").alias("far"), ((F.min("n") < F.max("n")) | F.first("same")).alias("linked")).where("linked and hub < far")
    links = filed.join(stars, ["key", "more"]).where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    sets = light.select("node", "small")
    links = links.join(sets.toDF("u", "own"), "u").join(sets.toDF("v", "other"), "v")
    return links.select("u", "v", "own", "other").mapInArrow(hold, "u long, v long")


ENTRY = "bucket int, hash binary, node binary, n binary"
ENTRY_ARROW = pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("node", pa.binary()), ("n", pa.binary())])


def _entries(h: np.ndarray, node: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    rows = list(by_bucket((h % U(buckets)).astype(np.int64), h, node, n.astype(np.int32)))
    return pa.RecordBatch.from_pylist([dict(zip(ENTRY_ARROW.names, r, strict=True)) for r in rows], ENTRY_ARROW)


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, node, n, length of its list) of the distinct entries of a bucket."""
    h, node, n = joined(table["hash"], np.uint64), joined(table["node"], np.int64), joined(table["n"], np.int32)
    order = np.lexsort((node, h))
    h, node, n = h[order], node[order], n[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
    h, node, n = h[new], node[new], n[new]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    run = np.cumsum(first) - 1
    return h, node, n, np.bincount(run)[run] if len(h) else run


def survivors(found: DataFrame, percent: int, smallest: int) -> DataFrame:
    """(node, n) of sets from ``smallest`` on that share enough of their smallest hashes with other sets.

    Of a hash that several sets of a batch hold, those sets are told on the spot
    and one entry goes on, so a shingle of all documents sends one a batch.
    """
    buckets = 2 * partitions(found.sparkSession)
    # n = 0 marks an entry that stands for several sets; decided rows hold counts by node
    back = pa.schema([("bucket", pa.int32()), ("node", pa.binary()), ("n", pa.binary()), ("shared", pa.binary())])
    sent = pa.schema([*ENTRY_ARROW, ("shared", pa.binary())])

    def counted(node: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        one, at, count = np.unique(node, return_index=True, return_counts=True)
        return by_bucket((mix(one.view(np.uint64)) % U(buckets)).astype(np.int64), one, n[at].astype(np.int32), count.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "low"):
                node, one = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)  # copies send one
                n = batch.column(1).to_numpy(zero_copy_only=False)[one]
                blobs = batch.column(2).take(pa.array(one)).to_pylist()
                size = np.array([len(b) // 8 for b in blobs], np.int64)
                h = np.frombuffer(b"".join(blobs), np.uint64)
                of = np.repeat(np.arange(len(one)), size)
                order = np.argsort(h, kind="stable")
                h, of = h[order], of[order]
                new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
                single = new & np.r_[new[1:], True] if len(h) else new
                first = new & ~single
                go = single | first
                rows = by_bucket((h[go] % U(buckets)).astype(np.int64), h[go], node[of[go]], np.where(single, n[of], 0)[go].astype(np.int32))
                yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "hash", "node", "n"), r, strict=True)) for r in rows], sent)
                told = of[~single]
                yield pa.RecordBatch.from_pylist([dict(zip(back.names, r, strict=True)) for r in counted(node[told], n[told])], sent)

    def shared(table: pa.Table) -> pa.Table:
        late = table.filter(pc.is_valid(table["shared"])).select(back.names).cast(back)
        rows = table.filter(pc.is_null(table["shared"]))
        h, node, n = joined(rows["hash"], np.uint64), joined(rows["node"], np.int64), joined(rows["n"], np.int32)
        order = np.lexsort((node, n, h))
        h, node, n = h[order], node[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1]) | (n[1:] != n[:-1])
        h, node, n = h[new], node[new], n[new]
        run_ = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1 if len(h) else np.zeros(0, np.int64)
        several = (np.bincount(run_) > 1) | (np.bincount(run_, n == 0) > 0) if len(h) else run_
        keep = several[run_] & (n > 0) if len(h) else run_.astype(bool)
        rows = pa.Table.from_pylist([dict(zip(back.names, r, strict=True)) for r in counted(node[keep], n[keep])], back)
        return pa.concat_tables([rows, late])

    def enough(table: pa.Table) -> pa.Table:
        node, n, count = joined(table["node"], np.int64), joined(table["n"], np.int32).astype(np.int64), joined(table["shared"], np.int32)
        node, at, of = np.unique(node, return_index=True, return_inverse=True)
        n, total = n[at], np.bincount(of, count, len(at))
        # what a set shares with its smallest possible partner at least
        keep = total >= demand(least(n, percent))
        return pa.table({"node": node[keep], "n": n[keep]})

    rows = found.where(F.col("n") >= smallest).select("node", "n", "low")
    filed = rows.mapInArrow(run, ENTRY + ", shared binary").groupBy("bucket").applyInArrow(shared, "bucket int, node binary, n binary, shared binary")
    return filed.groupBy("bucket").applyInArrow(enough, "node long, n long")


def whole_sets(documents: DataFrame, found: DataFrame, kept: DataFrame, text: str, k: int) -> DataFrame:
    """(node, n, hashes) of the nodes in kept; a node may stand twice, by texts that differ in case or white space."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                of, h, n = shingles(batch.column(0), k)
                node = digests(of, h, n)
                _, one = np.unique(node, return_index=True)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(node[one]), pa.array(n[one]), pa.array([h[e - c : e].tobytes() for c, e in zip(n[one].tolist(), ends[one].tolist(), strict=True)], pa.binary())], names=["node", "n", "hashes"])

    # texts are found by a hash of their bytes: one row of each text is read, no text is hashed into shingles but those wanted
    wanted = checkpointed(found.join(kept.select("node"), "node", "left_semi").select("text_hash").distinct())
    if wanted.count() <= FEW_TEXTS:  # then only the wanted texts are shuffled
        wanted = F.broadcast(wanted)
    texts = documents.select(F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash", "text"])
    return texts.select("text").mapInArrow(sets, "node long, n long, hashes binary")


def candidate_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join all sets which share a shingle of their prefixes, rare shingles first."""
    buckets = 2 * partitions(sets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                n = part.column(1).to_numpy(zero_copy_only=False)
                h = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64)
                yield _entries(h, np.repeat(part.column(0).to_numpy(zero_copy_only=False), n), np.repeat(n, n), buckets)

    back = "bucket int, hash binary, node binary, n binary, length binary"

    def counted(table: pa.Table) -> pa.Table:
        h, node, n, length = _lists(table)
        keep = length > 1
        h, node, n, length = h[keep], node[keep], n[keep], length[keep]
        rows = list(by_bucket((mix(node.view(np.uint64)) % U(buckets)).astype(np.int64), h, node, n, length.astype(np.int32)))
        return pa.Table.from_pylist([dict(zip(("bucket", "hash", "node", "n", "length"), r, strict=True)) for r in rows], ENTRY_ARROW.append(pa.field("length", pa.binary())))

    def prefixes(table: pa.Table) -> pa.Table:
        h, node, n, length = joined(table["hash"], np.uint64), joined(table["node"], np.int64), joined(table["n"], np.int32).astype(np.int64), joined(table["length"], np.int32)
        order = np.lexsort((h, length, node))
        h, node, n = h[order], node[order], n[order]
        _, at, count = np.unique(node, return_index=True, return_counts=True)
        rank = np.arange(len(node)) - np.repeat(at, count)
        # shingles in no other list come first in the order and need no entry
        alone = n - np.repeat(count, count)
        take = rank + alone < n - least(n, percent) + 1
        return pa.table({"hash": h[take].view(np.int64), "u": node[take]})

    filed = sets.mapInArrow(run, ENTRY).groupBy("bucket").applyInArrow(counted, back).groupBy("bucket").applyInArrow(prefixes, "hash long, u long")
    filed = checkpointed(filed)
    hubs = filed.groupBy("hash").agg(F.min("u").alias("v"))
    return filed.join(hubs, "hash").where("u <> v").select("u", "v").distinct()


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of similar sets, i in left and j in right, by incidence matrices over a part of the shingles at a time."""
    n = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(h, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    column, of = column[keep], of[keep]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    common = np.zeros((len(left), len(right)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[of[a:b], column[a:b] - start] = 1
        common += m[left] @ m[right].T
    union = n[left][:, None] + n[right][None, :] - common
    i, j = np.nonzero((100 * common.astype(np.float64) >= percent * union) & (left[:, None] != right[None, :]))
    return left[i], right[j]


def star_links(members: DataFrame, shape: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of each candidate group's sets to the group's smallest one, v; each set is compared once."""
    spark = members.sparkSession
    rows = members.join(shape.select("root", "blocks"), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # the smallest stands in every block of its group
    blocks = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    rows = rows.withColumn("block", F.explode(blocks))
    tile = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(16 * partitions(spark)))).otherwise(F.xxhash64("root", "block"))
    rows = rows.select(tile.alias("tile"), "root", "block", "node", "hashes")

    def run(table: pa.Table) -> pa.Table:
        root, block, node = (table[c].to_numpy() for c in ("root", "block", "node"))
        order = np.lexsort((node != root, block, root))  # a block's rows after the smallest
        hashes = table["hashes"]
        u, v, first = [], [], np.zeros(0, np.uint64)
        for i in order.tolist():
            own = np.frombuffer(hashes[i].as_py(), np.uint64)
            if node[i] == root[i]:
                first = own
                continue
            both = len(np.intersect1d(own, first, assume_unique=True))
            if 100 * both >= percent * (len(own) + len(first) - both):
                u.append(node[i])
                v.append(root[i])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.groupBy("tile").applyInArrow(run, "u long, v long")


def verified_links(sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join exactly the similar sets within each candidate group.

    First all sets of a group are held against its smallest one. Those that are
    similar to it are one component and aren't compared with each other any more;
    what is left meets them and itself in tiles of bounded size. A group of near
    copies of one text is done after the first step.
    """
    spark = sets.sparkSession
    groups = connected(links)
    members = checkpointed(groups.join(sets.dropDuplicates(["node"]), "node"))
    size = lambda rows, shingles: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")
    whole = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total")).withColumn("blocks", size(F.col("m"), F.col("total")))
    stars = checkpointed(star_links(members, whole, percent))
    near = stars.select(F.col("u").alias("node")).unionByName(members.where("node = root").select("node")).withColumn("near", F.lit(True))
    rows = members.join(near, "node", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    left = rows.where("NOT near").groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total")).select("root", size(F.col("m"), F.col("total")).alias("far_blocks"))
    # a group that fits a block is one tile; else those near the smallest have blocks of their own, which don't meet each other
    shape = whole.join(left, "root").select("root", "blocks", "far_blocks")
    rows = rows.join(shape, "root").withColumn("near_blocks", F.when(F.col("blocks") == 1, 0).otherwise(F.col("blocks")))
    far = F.col("near_blocks") + F.pmod(F.xxhash64("node"), F.col("far_blocks")).cast("int")
    rows = rows.withColumn("block", F.when(F.col("near") & (F.col("blocks") > 1), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).otherwise(far))
    last = F.col("near_blocks") + F.col("far_blocks") - 1
    others = F.explode(F.sequence(F.when(F.col("block") < F.col("near_blocks"), F.col("near_blocks")).otherwise(0), last)).alias("other")
    rows = rows.select("root", "node", "hashes", "blocks", "block", others).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    # small groups share a task, a larger group's tiles have keys of their own
    tile = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(16 * partitions(spark)))).otherwise(F.xxhash64("root", "low", "high"))
    rows = rows.select(tile.alias("tile"), "root", "low", "high", "block", "node", "hashes")

    def run(table: pa.Table) -> pa.Table:
        u, v = [], []
        table = table.sort_by([("root", "ascending"), ("low", "ascending"), ("high", "ascending")])
        marks = [table[c].to_numpy() for c in ("root", "low", "high")]
        cut = np.zeros(table.num_rows, bool)
        cut[0] = True
        for x in marks:
            cut[1:] |= x[1:] != x[:-1]
        limits = np.r_[np.flatnonzero(cut), table.num_rows]
        node, block = table["node"].to_numpy(), table["block"].to_numpy()
        for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
            hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].slice(a, b - a).to_pylist()]
            own = node[a:b]
            if marks[1][a] == marks[2][a]:
                left = right = np.arange(b - a)
            else:
                left, right = np.flatnonzero(block[a:b] == marks[1][a]), np.flatnonzero(block[a:b] == marks[2][a])
            if not len(left) or not len(right):
                continue
            i, j = similar_pairs(hashes, left, right, percent)
            root = forest(b - a, i, j)
            moved = np.flatnonzero(root != np.arange(b - a))
            u.append(own[moved])
            v.append(own[root[moved]])
        none = np.zeros(0, np.int64)
        return pa.table({"u": np.concatenate(u or [none]), "v": np.concatenate(v or [none])})

    return stars.unionByName(rows.groupBy("tile").applyInArrow(run, "u long, v long"))


def components(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """Per document: key, n_shingles, component_id (the smallest key reachable by links)."""
    found = checkpointed(nodes_of(documents, key, text, k, percent))
    nodes = found.where("n > 0").groupBy("node", "n").agg(F.min("id").alias("id"), F.first("small").alias("small"))
    sizes = {r["n"]: r["c"] for r in nodes.where(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count("*").alias("c")).collect()}
    most = boundary(sizes, percent)
    kept = survivors(found, percent, int(least(most + 1, percent)))
    sets = checkpointed(whole_sets(documents, found, kept, text, k))
    links = verified_links(sets, candidate_links(sets, percent), percent)
    links = links.unionByName(light_links(nodes, most, percent))
    roots = connected(links)
    named = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    # few nodes are linked: only their components are looked up
    linked = roots.join(nodes.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("linked_id"))
    named = named.join(linked, "root", "left").select("node", F.coalesce("linked_id", "id").alias("component"))
    return found.join(named, "node", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def keep_first(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest key.

    Rows with a null key can't be named and stay; of rows with equal key and text
    one stays; all columns pass through.
    """
    found = components(documents, key, text, k, percent)
    stay = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    return documents.join(stay, key, "left_semi").dropDuplicates([key, text]).unionByName(documents.where(F.col(key).isNull()))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS sh FROM places),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT u AS node, v AS reach FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.reach = e.u)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT node, min(reach) AS low FROM r GROUP BY node) m ON m.node = w.doc_id"""
