"""Session settings and small DataFrame helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import checkpointed, removed, shared_folder  # noqa: F401


FEW_EDGES = 500_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def released() -> None:
    """Give the process's free memory back to the system, where the C library can: workers go on to other tasks, a driver that trained a model to other work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not the GNU library: memory stays with the process


def unused(name: str, *taken: str) -> str:
    """``name``, with as many underscores after it as keep it apart from the names taken (Spark doesn't tell A from a)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of n nodes by links a[i] - b[i]."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def connected(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: from edges (u, v) to rows (node, root), root the smallest node reachable.

    Alternates two star steps: each node first hands the smallest neighbour to
    its larger neighbours, then to its smaller ones. The edges shrink to stars
    around the roots in a logarithmic number of rounds; each round is written
    to the shared folder. It ends when a round changes nothing: in each before,
    some edge gets smaller ends. Up to FEW_EDGES edges (16 bytes each) are joined
    in one task instead. Nodes without edges have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
        nodes, at = np.unique(np.r_[table["u"].to_numpy(), table["v"].to_numpy()], return_inverse=True)
        root = forest(len(nodes), at[: table.num_rows], at[table.num_rows :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])

    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.count() <= FEW_EDGES:
        return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = checkpointed(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
