"""Ranks and running totals over all rows of a table, by a scan in levels.

Rows are dealt by ranges of the order and numbered within their range; the ranges'
counts and sums are summed up by a scan of their own, in runs of ``FANOUT`` ranges, runs
of runs, and so on. No task holds more than a range or a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import checkpointed

#: Rows to a range at most (about), and ranges or runs to a run.
RANGE_ROWS, FANOUT = 1 << 22, 1024


def offsets(sums: DataFrame, names: list[str], ranges: int) -> DataFrame:
    """(part, names): for each of the parts 0 to ranges - 1 that occur, the sums of those before it."""
    if ranges <= 1:
        return sums.select("part", *(F.lit(0).cast(kind).alias(n) for n, kind in sums.dtypes if n in names))
    run = F.floor(F.col("part") / FANOUT).cast("long")
    before = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    kinds = dict(sums.dtypes)
    within = sums.withColumn("run", run).select("part", "run", *(F.coalesce(F.sum(n).over(before), F.lit(0)).cast(kinds[n]).alias(n) for n in names))
    if ranges <= FANOUT:
        return within.drop("run")
    runs = sums.groupBy(run.alias("part")).agg(*(F.sum(n).cast(kinds[n]).alias(n) for n in names))
    above = offsets(runs, names, -(-ranges // FANOUT)).select(F.col("part").alias("run"), *(F.col(n).alias(f"above_{n}") for n in names))
    return within.join(above, "run").select("part", *((F.col(n) + F.col(f"above_{n}")).cast(kinds[n]).alias(n) for n in names))


def ranked(df: DataFrame, order: list[Column], rank: str = "rank", totals: dict[str, str] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with its place in the order (1 is first), and running totals {name: column} up to and with each row.

    The order has to be total for results to be fixed: rows that are equal in it are
    numbered in any order, but each its own number. Nulls add nothing to a total; sums
    keep the type that SUM gives them. The rows are shuffled once by the order, and once
    more within ranges if there are totals.
    """
    totals = totals or {}
    ranges = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // range_rows))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # part and number in it, as they are once the rows are written
    rows = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sums = rows.groupBy(part.alias("part")).agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_{name}") for name, c in totals.items()))
    names = ["_n", *(f"_{name}" for name in totals)]
    sums = checkpointed(sums.select("part", "_n", *(F.coalesce(n, F.lit(0)).cast(kind).alias(n) for n, kind in sums.dtypes[2:])))
    most = sums.agg(F.max("part")).first()[0]
    before = offsets(sums, names, (most or 0) + 1)
    placed = rows.withColumn("part", part).join(before.withColumnsRenamed({n: f"{n}_before" for n in names}), "part")
    upto = Window.partitionBy("part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn(rank, F.col("_n_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    for name, c in totals.items():
        placed = placed.withColumn(name, F.col(f"_{name}_before") + F.coalesce(F.sum(c).over(upto), F.lit(0)))
    return placed.select(*df.columns, rank, *totals)
