"""Exact top-k search by inner product.

Vectors become integers floor(scale * x). Queries are dealt into stripes of at
most ``HELD_BYTES`` and candidates into parts, and a cell is one stripe against
one part. A task holds its stripe as blocks, and the part's vectors stream past
as shards, a batch of rows each; a shard against a block is a tile: a matrix
product, from which each query keeps its k best, held against the k best of the
tiles before. The cells' lists meet by a tree over (query, branch) and finally
by query. Only a count of rows and queries and the longest vector's length reach
the driver. Products are exact: float64 where every sum stays below 2**53, else
64-bit or unbounded integers, cut to the range of long.

Results for odd input: vectors that are null, empty or hold null or non-finite
components take no part; vectors of another length are no candidates of a
query; a query with fewer candidates has fewer rows; equal scores go to the
smaller id; repeated rows of an id are candidates each, and a query id that
occurs repeatedly is asked once, with the row whose vector is least; rows
without an id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions

BLOCK_ROWS = 1024
#: Bytes of a task's queries; bytes up to which copies of queries, one for each part, don't matter beside the candidates.
HELD_BYTES, FEW_BYTES = 1 << 26, 1 << 28
#: Scores of a tile over the bars of its queries, beyond which the tile's own k best are selected first.
MANY = 1 << 20
LONG = (-(1 << 63), (1 << 63) - 1)


def integer_vectors(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id long, v array<double>): whole-number components; unusable vectors are left out."""
    x = F.col(vector).cast("array<double>")
    usable = F.col(key).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # floor() of a double gives a long and would wrap beyond it, so the whole part is found by remainder
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: c * scale).alias("v")).where(F.forall("v", lambda c: F.abs(c) != float("inf")))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, matrix) for each length of a batch's vectors."""
    ids, v = batch["id"].to_numpy(zero_copy_only=False), batch["v"]
    lengths = v.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = np.floor(v.flatten().to_numpy(zero_copy_only=False)), np.cumsum(lengths)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield int(dim), ids[at], flat[(ends[at] - dim)[:, None] + np.arange(dim)]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return a @ b.T
    if top < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    return np.array([[min(max(sum(x * y for x, y in zip(p, q, strict=True)), LONG[0]), LONG[1]) for q in whole[1]] for p in whole[0]], np.int64)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple:
    order = np.lexsort((ids, ~score, query))  # ~score falls as score rises and can't overflow
    query, ids, score = query[order], ids[order], score[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], ids[rank < k], score[rank < k]


def _tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int, bar: tuple | None = None) -> tuple:
    """The tile's (query, id, score) that may be among a query's k best. bar: the score and id of each query's k-th best so far."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    score = _product(queries, values)
    over = score >= bar[0][:, None] if bar else None
    if bar and np.count_nonzero(over) > MANY:  # say, of candidates that get better and better
        bar = None
    if bar:
        q, c = np.nonzero(over)
        least, last = bar[0][q], bar[1][q]
    else:
        own = query_ids[:, None] == ids[None, :]
        if score.shape[1] > k:  # those below the k-th best other score can't matter
            low = np.partition(np.where(own, LONG[0], score), score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        else:
            low = np.full(len(query_ids), LONG[0])
        q, c = np.nonzero(~own & (score >= low[:, None]))
        # of those equal to it the first k in the order of ids
        level = score[q, c] == low[q]
        before = np.cumsum(level) - level
        first = before[np.searchsorted(q, q)]
        kept = ~level | (before - first < k)
        q, c = q[kept], c[kept]
    found = query_ids[q], ids[c], score[q, c].astype(np.int64)
    if bar:
        kept = (found[0] != found[1]) & ((found[2] > least) | (found[1] < last))
        found = tuple(x[kept] for x in found)
    return _best(*found, k)


class _Block:
    """Queries of one length, with their k best candidates so far."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        none = np.zeros(0, np.int64)
        self.ids, self.values, self.held, self.bar = ids, values, (none, none, none), None

    def meet(self, ids: np.ndarray, values: np.ndarray, k: int) -> None:
        found = _tile(self.ids, self.values, ids, values, k, self.bar)
        if len(found[0]):
            self.held = _best(*(np.concatenate(x) for x in zip(self.held, found, strict=True)), k)
            last = np.searchsorted(self.held[0], self.ids, "right") - 1
            if np.all(last - np.searchsorted(self.held[0], self.ids) == k - 1):
                self.bar = self.held[2][last], self.held[1][last]


def _search(k: int):
    """The k best of each cell: rows (cell, asked, id, v) come by cell, its queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, blocks = None, {}, {}

        def out() -> Iterator[pa.RecordBatch]:
            for block in (b for same in blocks.values() for b in same):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in block.held], names=["query_id", "id", "score"])

        for batch in batches:
            at, asked = batch["cell"].to_numpy(), batch["asked"].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (asked[1:] != asked[:-1])]) if len(at) else []
            for i, j in zip(starts, [*starts[1:], len(at)], strict=True):
                if at[i] != cell:
                    yield from out()
                    cell, waiting, blocks = at[i], {}, {}
                if asked[i]:
                    for dim, ids, values in _by_length(batch.slice(i, j - i)):
                        waiting.setdefault(dim, []).append((ids, values))
                    continue
                while waiting:
                    dim, held = waiting.popitem()
                    ids, values = map(np.concatenate, zip(*held, strict=True))
                    order = np.argsort(ids)
                    blocks[dim] = [_Block(ids[o], values[o]) for o in (order[n : n + BLOCK_ROWS] for n in range(0, len(order), BLOCK_ROWS))]
                for dim, ids, values in _by_length(batch.slice(i, j - i)):
                    for block in blocks.get(dim, ()):
                        block.meet(ids, values, k)
        yield from out()

    return run


def _grid(rows: int, asked: int, dim: int, tasks: int) -> tuple[int, int]:
    """Parts of the candidates and stripes of the queries: stripes so that a task can hold one, parts so that copies of queries are at most half as many as those of candidates."""
    one = 8 * max(1, dim)
    stripes = max(1, -(-asked * one // HELD_BYTES))
    copies = max(rows * stripes // 2, FEW_BYTES // one)
    return max(1, min(-(-tasks // stripes), copies // max(1, asked))), stripes


def top_k(df: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """Per query its k best candidates: query_id long, rank int, <key> long, score long."""
    spark = df.sparkSession
    size = df.agg(F.count("*").alias("rows"), F.count_if(is_query).alias("asked"), F.max(F.size(vector)).alias("dim")).first()
    parts, stripes = _grid(size["rows"], size["asked"], size["dim"] or 1, 2 * partitions(spark))
    whole = integer_vectors(df, key, vector, scale)
    asked = integer_vectors(df.where(is_query), key, vector, scale).groupBy("id").agg(F.min("v").alias("v"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # rows are dealt to parts in turn, so that copies of a row are spread
    candidates = whole.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts))).withColumn("stripe", each(stripes))
    queries = asked.withColumn("stripe", F.pmod(F.xxhash64("id"), F.lit(stripes))).withColumn("part", each(parts))
    cell = (F.col("part") * stripes + F.col("stripe")).cast("int").alias("cell")
    both = queries.select(cell, F.lit(True).alias("asked"), "id", "v").unionByName(candidates.select(cell, F.lit(False).alias("asked"), "id", "v"))
    tiles = both.repartitionById(parts * stripes, "cell").sortWithinPartitions("cell", F.desc("asked")).mapInArrow(_search(k), "query_id long, id long, score long")
    order = [F.desc("score"), F.asc("id")]
    # the tree: lists meet by (query, branch) first, so that no task gets the lists of all cells of a query
    tiles = tiles.withColumn("branch", F.pmod(F.xxhash64("id"), F.lit(16)))
    half = tiles.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "branch").orderBy(*order))).where(F.col("r") <= k)
    ranked = half.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product([CAST(x AS DOUBLE) FOR x IN q.w], [CAST(x AS DOUBLE) FOR x IN c.w]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
