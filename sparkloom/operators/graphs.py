"""Cycles, explosions and chains of graphs that are tables: edges of any number, paths of any length.

Nothing here holds a path. What a recursive query tells by the nodes it has come
along is told by labels on nodes instead, which one join with the edges (or with the
labels themselves) moves on. Each round is written to the shared folder, so plans stay
short and a lost executor costs one round. Joins meet rows of any number with one label
a node; a node with very many edges is split by adaptive execution, and what reaches a
node is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import checkpointed

#: Nodes without a way in or out are taken off at most so many times before labels are spread; edges that one task takes.
TRIMS, FEW_EDGES = 3, 200_000


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges that may lie on a cycle, after a few rounds; the labels deal with what is left of long chains."""
    for _ in range(TRIMS):
        before = edges.count()
        if not before:
            break
        entered, left = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = checkpointed(edges.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst"))
        if edges.count() > 0.9 * before:
            break
    return edges


def _first_reaching(edges: DataFrame) -> DataFrame:
    """(node, label): the first node, in an order by hash, that reaches each one, itself included.

    A label passes along edges, and at once from the node that it names: what reaches
    that one reaches all that it reaches, so labels leap as well as walk.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    labels = checkpointed(nodes.select("node", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n")).alias("label")))
    while True:
        passed = edges.join(labels, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("passed"))
        walked = checkpointed(labels.join(passed, "node", "left").select("node", F.least("label", F.coalesce("passed", "label")).alias("new"), F.col("label").alias("old")))
        named = walked.select(F.col("node").alias("name"), F.col("new").alias("leapt"))
        leapt = checkpointed(walked.join(named, F.col("new.n") == F.col("name")).select("node", F.col("leapt").alias("label"), "old"))
        labels = leapt.select("node", "label")
        if leapt.where("label <> old").isEmpty():
            return labels.select("node", F.col("label.n").alias("label"))


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of few edges: components by one walk in depth first order, with numbers and lowest numbers reached."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead: dict = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ahead.setdefault(a, []).append(b)
                ahead.setdefault(b, [])
        number: dict = {}
        low: dict = {}
        open_: list = []
        closed: set = set()
        out: list[tuple] = []
        for start in ahead:
            todo = [(start, iter(ahead[start]))] if start not in number else []
            while todo:
                node, rest = todo[-1]
                if node not in number:
                    number[node] = low[node] = len(number)
                    open_.append(node)
                for below in rest:
                    if below not in number:
                        todo.append((below, iter(ahead[below])))
                        break
                    if below not in closed:
                        low[node] = min(low[node], number[below])
                else:
                    todo.pop()
                    if todo:
                        low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                    if low[node] == number[node]:
                        held = [open_.pop()]
                        while held[-1] != node:
                            held.append(open_.pop())
                        closed.update(held)
                        if len(held) > 1:
                            out += [(x, min(held)) for x in held]
        kind_of = batch.schema.field(0).type if ahead else pa.int64()
        if ahead:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind_of) for i in (0, 1)], names=["node", "component"])

    return edges.select("src", "dst").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def cyclic_components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) of each node on a cycle of edges (src, dst): component is the smallest node that it reaches and that reaches it.

    Strongly connected components by colours: each node takes the first node, in an
    order by hash, that reaches it; nodes of a colour that lead back to the node which
    gave it are a component with it; edges between colours, and at such nodes, lie on no
    other cycle. This is done again on the rest, which falls apart at random places
    (a chain into halves, on average), until ``few`` edges are left for one task. Nodes
    on no cycle have no row; edges with a null end lead nowhere; repeated edges count once.
    """
    rest = checkpointed(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    loops = rest.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    rest, found = rest.where("src <> dst"), []
    while True:
        count = rest.count()
        if count <= few:
            if count:
                found.append(checkpointed(_in_one_task(rest)))
            break
        rest = _trimmed(rest)
        labels = _first_reaching(rest)
        of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))  # noqa: B023, E731
        inner = checkpointed(rest.join(of("src"), "src").join(of("dst"), "dst").where("src_label = dst_label").select("src", "dst", F.col("src_label").alias("label")))
        # back from each colour's own node along its edges
        reached = frontier = checkpointed(inner.where("dst = label").select(F.col("src").alias("node"), F.col("label").alias("first")).distinct())
        while not frontier.isEmpty():
            above = inner.join(frontier.select(F.col("node").alias("dst"), "first"), "dst").where("src <> label").select(F.col("src").alias("node"), "first").distinct()
            frontier = checkpointed(above.join(reached.select("node"), "node", "left_anti"))
            reached = reached.unionByName(frontier)
        whole = checkpointed(reached.unionByName(reached.select(F.col("first").alias("node"), "first")).distinct())
        found.append(whole.join(whole.groupBy("first").agg(F.min("node").alias("component")), "first").select("node", "component"))
        # a colour's own node is done, whether it lies on a cycle or not
        done = checkpointed(whole.select("node").union(labels.where("node = label").select("node")).distinct())
        rest = checkpointed(inner.select("src", "dst").join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    if not found:
        return loops
    cycles = reduce(DataFrame.unionByName, found)
    return cycles.unionByName(loops.join(cycles.select("node"), "node", "left_anti"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level) of an acyclic graph of edges (src, dst): the most edges that lead to a node from one without a way in. A cycle raises ValueError."""
    rest = checkpointed(edges.select("src", "dst").distinct())
    level, taken = 0, [rest.limit(0).withColumn("level", F.lit(0))]
    while not rest.isEmpty():
        # what no edge left leads to is on this level, with all its edges
        ready = rest.select("src").distinct().join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_anti").withColumn("ready", F.lit(True))
        told = checkpointed(rest.join(ready, "src", "left").select("src", "dst", "ready"))
        now = told.where("ready").select("src", "dst", F.lit(level).alias("level"))
        if now.isEmpty():
            raise ValueError("the graph has a cycle")
        taken.append(now)
        rest = told.where("ready IS NULL").select("src", "dst")
        level += 1
    every = reduce(DataFrame.unionByName, taken)
    above = every.select(F.col("src").alias("node"), "level").distinct()
    ends = every.groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("level"))
    return above.unionByName(ends.join(above.select("node"), "node", "left_anti"))


def explosion(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, piece, needed): how many of each piece a root holds, over all ways down edges (whole, piece, n).

    Pieces are taken level by level: when all wholes of a level are summed, they hand
    their sums, times n, to their pieces, each once; so the work is that of the edges
    below each root and not that of the ways, whose number grows with a power of the
    depth. Without ``roots`` (a column named root) those are all wholes that are no
    piece. Repeated edges add up; needed is a whole number of up to 38 digits. A cycle
    raises ValueError.
    """
    big = "decimal(38,0)"
    edges = checkpointed(edges.where("whole IS NOT NULL AND piece IS NOT NULL").groupBy("whole", "piece").agg(F.sum("n").cast(big).alias("n")))
    levels = checkpointed(topological_levels(edges.select(F.col("whole").alias("src"), F.col("piece").alias("dst"))))
    depth = levels.agg(F.max("level")).first()[0]
    if roots is None:
        roots = levels.where("level = 0").select(F.col("node").alias("root"))
    down = checkpointed(edges.join(levels, F.col("piece") == F.col("node")).select("whole", "piece", "n", "level"))
    starts = roots.select("root").distinct().join(levels, F.col("root") == F.col("node"))
    waiting = checkpointed(starts.select("root", F.col("node").alias("piece"), F.lit(1).cast(big).alias("needed"), "level"))
    out = []
    for level in range((depth or 0) + 1):
        now = waiting.where(F.col("level") == level).groupBy("root", "piece").agg(F.sum("needed").cast(big).alias("needed"))
        out.append(now)
        handed = now.withColumnRenamed("piece", "whole").join(down, "whole").groupBy("root", "piece", "level").agg(F.sum((F.col("needed") * F.col("n")).cast(big)).cast(big).alias("needed"))
        waiting = checkpointed(waiting.where(F.col("level") > level).unionByName(handed))
    return reduce(DataFrame.unionByName, out).where("root <> piece")


#: How two stretches of a chain are joined, by name of the measure's kind.
JOINED = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}


def chains(steps: DataFrame, measures: dict[str, str] | None = None) -> DataFrame:
    """(id, last, steps, measures): where the way along rows (id, next) ends, for each row, the row itself included.

    Each row points along its way and knows the steps and measures up to there; a
    round lets it point where its goal points, so ways double and the rounds are as many
    as the digits of the longest way. ``measures`` are columns of steps with how they are
    joined (sum, min, max). A next that is no id ends the way. Ways that lead into a
    cycle have no end: last, steps and measures are null. Ids have to be unique.
    """
    measures = measures or {}
    base = steps.select("id", "next", F.lit(1).cast("long").alias("steps"), *measures)
    known = base.select(F.col("id").alias("next"), F.lit(True).alias("known"))
    base = checkpointed(base.join(known, "next", "left").select("id", F.when(F.col("known"), F.col("next")).alias("next"), F.col("id").alias("last"), "steps", *measures))
    many = max(1, base.count())
    done, open_ = [base.where("next IS NULL")], base.where("next IS NOT NULL")
    ahead = base
    rounds = 0
    while not open_.isEmpty() and 1 << rounds <= 2 * many:
        goal = ahead.select(F.col("id").alias("next"), F.col("next").alias("beyond"), F.col("last").alias("goal_last"), F.col("steps").alias("goal_steps"), *(F.col(m).alias(f"goal_{m}") for m in measures))
        joined: list[Column] = [JOINED[kind](F.col(m), F.col(f"goal_{m}")).alias(m) for m, kind in measures.items()]
        open_ = checkpointed(open_.join(goal, "next").select("id", F.col("beyond").alias("next"), F.col("goal_last").alias("last"), (F.col("steps") + F.col("goal_steps")).alias("steps"), *joined))
        done.append(open_.where("next IS NULL"))
        ahead = reduce(DataFrame.unionByName, done).unionByName(open_.where("next IS NOT NULL"))
        open_ = open_.where("next IS NOT NULL")
        rounds += 1
    ended = reduce(DataFrame.unionByName, done).select("id", "last", "steps", *measures)
    kinds = dict(ended.dtypes)
    return ended.unionByName(open_.select("id", *(F.lit(None).cast(kinds[c]).alias(c) for c in ("last", "steps", *measures))))
