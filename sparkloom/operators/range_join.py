"""Range joins as equi-joins on the nodes of an interval tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a value that a level of the tree stands for, and of the span of all ranges.
BITS, SPAN_BITS = 2, 30
#: Nodes of all ranges, or asked for by all points, up to which that side is broadcast instead of dealing both out.
FEW_NODES = 100_000


def _number(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.simpleString()
    c = F.col(column)
    if kind in ("timestamp", "timestamp_ntz", "date"):
        # without a time zone, so that no hour is missing or double
        return F.timestamp_diff("microsecond", F.expr("timestamp_ntz'1970-01-01'"), c.cast("timestamp_ntz")).cast("double")
    return c.cast("double")


def _nodes(low: str, high: str, bits: int, levels: int) -> Column:
    """The nodes (level, place) that make up the stretch of whole numbers from low to high, each as large as it can be.

    On a level lie the blocks of 2 ** (bits * level) numbers that are wholly inside; those that a block one level up holds are left out.
    """
    first = f"shiftright({low} + shiftleft(1L, int({bits} * l)) - 1, int({bits} * l))"
    last = f"(shiftright({high} + 1, int({bits} * l)) - 1)"
    up_first, up_last = (x.replace("* l)", "* (l + 1))") for x in (first, last))
    wide = 1 << bits
    whole = f"CASE WHEN {first} <= {last} THEN sequence({first}, {last}) ELSE array() END"
    left = f"CASE WHEN {first} < {up_first} * {wide} THEN sequence({first}, {up_first} * {wide} - 1) ELSE array() END"
    right = f"CASE WHEN ({up_last} + 1) * {wide} <= {last} THEN sequence(({up_last} + 1) * {wide}, {last}) ELSE array() END"
    places = f"CASE WHEN {up_first} > {up_last} THEN {whole} ELSE concat({left}, {right}) END"
    return F.expr(f"flatten(transform(sequence(0, {levels}), l -> transform({places}, p -> struct(l AS level, p AS place))))")


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, bits: int = BITS) -> DataFrame:
    """Rows of points with each row of ranges whose [low, high] holds the point's value.

    Ranges may be of any width, all in one join: values are cut into 2 ** SPAN_BITS
    steps of what the ranges span, and a range is filed at the nodes of a tree over the
    steps that make it up, a few on each level and the logarithm of its width in all. A
    point asks at its own node of each level that ranges use, and meets a range at one
    node at most; the limits are compared as they are. Ranges of up to FEW_NODES nodes, or
    else points that ask at no more, are broadcast; beyond, both sides are dealt by node,
    and a node with very many points is split by adaptive execution. Which it is follows
    from counts: Spark takes points for as small as their table, but they stand there once
    a level. Beside what is broadcast only the span and the number of nodes on each level
    (SPAN_BITS / bits of them at most) reach the driver. Null limits and values, and
    limits in wrong order, meet nothing. The sides have no column name in common.
    """
    levels = SPAN_BITS // bits + 1
    proper = ranges.where(F.col(low) <= F.col(high))
    a, b, x = _number(ranges, low), _number(ranges, high), _number(points, point)
    finite = lambda c: F.when(F.abs(c) < F.lit(float("inf")), c)
    span = proper.agg(F.min(a).alias("low"), F.max(b).alias("high"), F.least(F.min(finite(a)), F.min(finite(b))).alias("start"), F.greatest(F.max(finite(a)), F.max(finite(b))).alias("end")).first()
    top, start, end = 1 << SPAN_BITS, span["start"] or 0.0, span["end"] or 0.0
    step = end / top - start / top

    def place(c: Column) -> Column:
        # NaN is the greatest value
        at = F.floor(c / F.lit(step) - F.lit(start / step)) if step > 0 else F.lit(0)
        return F.when(F.isnan(c), top).otherwise(F.greatest(F.lit(0), F.least(at, F.lit(top)))).cast("long")

    filed = proper.withColumns({"_a": place(a), "_b": place(b)}).withColumn("_node", F.explode(_nodes("_a", "_b", bits, levels))).drop("_a", "_b")
    nodes = {r["level"]: r["count"] for r in filed.groupBy("_node.level").count().collect()}
    used = sorted(nodes)
    inside = points.where((x >= F.lit(span["low"])) & (x <= F.lit(span["high"]))) if used else points.limit(0)
    asks = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.shiftright(place(x), bits * n).alias("place")) for n in used)).cast("array<struct<level:int,place:bigint>>"))
    asking = inside.withColumn("_node", asks)
    if sum(nodes.values()) <= FEW_NODES:
        met = asking.join(F.broadcast(filed), "_node")
    elif inside.count() * len(used) <= FEW_NODES:
        met = F.broadcast(asking).join(filed, "_node")
    else:
        met = asking.join(filed.hint("merge"), "_node")
    return met.where(F.col(point).between(F.col(low), F.col(high))).drop("_node")
