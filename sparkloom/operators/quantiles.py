"""Exact quantiles by few keys over many rows, without bringing a key's values into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import checkpointed

#: Parts that a stretch is cut into, values that may be put in order in one task, and stretches that are sent to all tasks.
STRETCHES, FEW, FEW_STRETCHES = 1024, 1 << 16, 1 << 14


def quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float], stretches: int = STRETCHES, few: int = FEW) -> DataFrame:
    """(key, one column for each named share): interpolated between neighbours, as percentile_cont does; nulls are left out.

    A wanted rank lies in a stretch of its key's values, at first all of them. Counts
    by equal parts of the stretch tell which part holds the rank; that part, from the least
    to the greatest value really in it, is the next stretch, until it has ``few`` values
    or one: a value far off takes one round more, not all others into one task. Rows are
    counted where they lie; only counts by part are shuffled, and last the values of
    small stretches. There are as many stretches as keys times ranks; up to FEW_STRETCHES
    are sent to all tasks, more are joined by key. Infinite values and NaN (the greatest)
    are values like others.
    """
    if not all(0 <= p <= 1 for p in shares.values()):
        raise ValueError(f"shares are from 0 to 1, not {shares}")
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    ends = rows.groupBy("k").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    # each share's rank from below and above; equal ranks of a key are one
    at = [F.lit(p) * (F.col("n") - 1) for p in shares.values()]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(a), F.ceil(a)) for a in at))))
    open_ = checkpointed(ends.select("k", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("before"), "n"))
    totals = checkpointed(ends.select("k", F.col("n").alias("total")))
    found, small = [], []

    def inside(wanted: DataFrame) -> DataFrame:
        near = F.broadcast(wanted) if wanted.count() <= FEW_STRETCHES else wanted
        return rows.join(near, "k").where(F.col("v").between(F.col("low"), F.col("high")))

    while not open_.isEmpty():
        found.append(open_.where("low = high").select("k", "rank", F.col("low").alias("v")))
        small.append(open_.where((F.col("low") < F.col("high")) & (F.col("n") <= few)))
        wide = open_.where((F.col("low") < F.col("high")) & (F.col("n") > few))
        # the ends are parts by themselves, so that each round takes them off; halves, as a difference of limits may exceed a double
        share = F.nanvl((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2), F.lit(0.0))
        part = F.when(F.col("v") == F.col("low"), 0).when(F.col("v") == F.col("high"), stretches + 1).otherwise(F.least(F.lit(stretches), F.floor(share * stretches) + 1).cast("int"))
        parts = inside(wide).groupBy("k", "rank", "before", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = Window.partitionBy("k", "rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        placed = parts.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
        open_ = checkpointed(placed.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).select(*open_.columns))
    if not found:
        return df.select(key).limit(0).select("*", *(F.lit(None).cast("double").alias(name) for name in shares))
    # the values of small stretches in order, with how often each stands there
    stretch = reduce(DataFrame.unionByName, small)
    held = inside(stretch).groupBy("k", "rank", "before", "v").agg(F.count("*").alias("n"))
    last = F.col("before") + F.sum("n").over(Window.partitionBy("k", "rank").orderBy("v"))
    held = held.withColumn("last", last).where((F.col("rank") < F.col("last")) & (F.col("rank") >= F.col("last") - F.col("n"))).select("k", "rank", "v")
    values = reduce(DataFrame.unionByName, found).unionByName(held)
    wanted = values.join(totals, "k")
    out = []
    for name, p in shares.items():
        spot = F.lit(p) * (F.col("total") - 1)
        low, high = (F.max(F.when(F.col("rank") == f(spot), F.col("v"))) for f in (F.floor, F.ceil))
        spot = F.lit(p) * (F.max("total") - 1)
        out.append((F.when(F.floor(spot) == F.ceil(spot), low).otherwise((F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high)).alias(name))
    return wanted.groupBy(F.col("k").alias(key)).agg(*out)
