"""Graphs, orders over all rows, interval and fuzzy joins, and quantiles against plain Python."""

import datetime
import random
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import fuzzy_join, graphs, ordered, quantiles, range_join


def reach(edges):
    ahead = defaultdict(set)
    for a, b in edges:
        ahead[a].add(b)
    out = {}
    for start in list(ahead):
        seen, todo = set(), [start]
        while todo:
            new = ahead.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out[start] = seen
    return out


def plain_components(edges):
    r = reach(edges)
    return {(a, min(b for b in r[a] if a in r.get(b, ()))) for a in r if a in r[a]}


def edge_lists():
    rng = random.Random(5)
    yield [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (5, 6)]
    yield [(i, (i + 1) % 20) for i in range(20)] + [(i, 100 + i) for i in range(5)]  # one long cycle
    yield [(i, i + 1) for i in range(14)]  # a chain, no cycle
    yield [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]
    yield [(rng.randrange(60), rng.randrange(60)) for _ in range(90)]
    yield [(0, i) for i in range(1, 50)] + [(i, 0) for i in range(1, 50, 3)]  # a hub
    yield [(9, 8), (8, 9), (8, 7), (7, 6), (6, 7), (2, 9), (1, 1), (1, 2), (2, 1)]


@pytest.mark.parametrize(("edges", "few"), [(e, f) for e in edge_lists() for f in (graphs.FEW_EDGES, 0)][:-2])
def test_cyclic_components(spark, edges, few):
    df = spark.createDataFrame(edges + edges[:3] + [(None, 1), (2, None)], "src long, dst long")
    got = graphs.cyclic_components(df, few).collect()
    assert len(got) == len({r.node for r in got})
    assert {tuple(r) for r in got} == plain_components(edges)


def test_cyclic_components_of_names_and_of_nothing(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "a")], "src string, dst string")
    assert {tuple(r) for r in graphs.cyclic_components(df).collect()} == {("a", "a"), ("b", "a")}
    assert graphs.cyclic_components(df.limit(0)).count() == 0


def test_levels_and_explosion(spark):
    rng = random.Random(8)
    edges = [(a, b, rng.randint(1, 3)) for a, b in {(rng.randrange(30), rng.randrange(30)) for _ in range(70)} if a > b]
    edges += [(90, 91, 1), (90, 91, 2), (None, 3, 1), (91, None, 1)]
    ahead, needed = defaultdict(list), defaultdict(int)
    for a, b, n in edges:
        if a is not None and b is not None:
            ahead[a].append((b, n))

    def down(root, node, times):
        for b, n in ahead[node]:
            needed[root, b] += times * n
            down(root, b, times * n)

    pieces = {b for _, b, _ in edges}
    for root in [a for a in list(ahead) if a not in pieces]:
        down(root, root, 1)
    df = spark.createDataFrame(edges, "whole long, piece long, n long")
    assert {(r.root, r.piece): int(r.needed) for r in graphs.explosion(df).collect()} == dict(needed)
    one = max(ahead, key=lambda a: len(ahead[a]))
    needed.clear()
    down(one, one, 1)
    some = graphs.explosion(df, spark.createDataFrame([(one,), (one,), (12345,)], "root long"))
    assert {(r.root, r.piece): int(r.needed) for r in some.collect()} == dict(needed)


def test_explosion_counts_ways_without_walking_them(spark):
    edges = [(i, i + 1, 200_000) for i in range(7)] + [(i, i + 1, 1) for i in range(7)]  # far beyond 64 bits
    got = {r.piece: int(r.needed) for r in graphs.explosion(spark.createDataFrame(edges, "whole long, piece long, n long").coalesce(1)).collect()}
    assert got == {i: 200_001**i for i in range(1, 8)}


def test_cycles_have_no_levels(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "src long, dst long")
    with pytest.raises(ValueError, match="cycle"):
        graphs.topological_levels(df)
    empty = spark.createDataFrame([], "whole long, piece long, n long")
    assert graphs.explosion(empty).count() == 0


def test_chains(spark):
    rng = random.Random(4)
    rows = [(i, i + 1 if i % 9 else None, rng.randint(0, 9)) for i in range(1, 40)]  # stretches of 9
    rows += [(100, 101, 1), (101, 102, 2), (102, 100, 3), (103, 101, 4), (104, 104, 5)]  # cycles, and a way into one
    rows += [(200 + i, 300, i) for i in range(20)] + [(300, 999, 7)]  # a hub whose next is no id
    after = {i: n for i, n, _ in rows}
    value = {i: v for i, _, v in rows}
    expected = {}
    for i in after:
        way = [i]
        while after[way[-1]] in after and len(way) <= len(rows):
            way.append(after[way[-1]])
        on = [value[x] for x in way]
        expected[i] = (None,) * 5 if len(way) > len(rows) else (way[-1], len(way), sum(on), max(on), min(on))
    df = spark.createDataFrame([(i, n, v, v, v) for i, n, v in rows], "id long, next long, total long, most long, least long")
    got = graphs.chains(df, {"total": "sum", "most": "max", "least": "min"}).collect()
    assert len(got) == len(rows) and {r.id: tuple(r)[1:] for r in got} == expected
    assert graphs.chains(df.limit(0)).count() == 0


@pytest.mark.parametrize(("fanout", "range_rows"), [(1024, 1 << 22), (2, 9), (3, 1)])
def test_order_over_all_rows(spark, monkeypatch, fanout, range_rows):
    monkeypatch.setattr(ordered, "FANOUT", fanout)
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 2, 7]), i, rng.choice([None, -3, 0, 10])) for i in range(120)]
    df = spark.createDataFrame(rows, "a int, b int, v long").repartition(5)
    got = ordered.ranked(df, [F.desc_nulls_last("a"), F.asc("b")], "r", {"upto": "v"}, range_rows).collect()
    right = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    total, expected = 0, []
    for k, row in enumerate(right, 1):
        total += row[2] or 0
        expected.append((*row, k, total))
    assert sorted((tuple(r) for r in got), key=lambda r: r[3]) == expected
    same = ordered.ranked(spark.range(50).selectExpr("1 AS a"), [F.asc("a")], range_rows=range_rows).collect()
    assert sorted(r.rank for r in same) == list(range(1, 51))
    assert ordered.ranked(df.limit(0), [F.asc("a")], "r", {"upto": "v"}).count() == 0


def test_ranges_of_all_widths(spark):
    rng, start = random.Random(6), datetime.datetime(2015, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    points = [(i, at(rng.randrange(400_000_000))) for i in range(60)] + [(60, None), (61, at(-5)), (62, at(0)), (63, at(10))]
    ranges = [(i, at(a := rng.randrange(300_000_000)), at(a + width)) for i, width in enumerate([0, 1, 60, 3600, 86_400, 10**7, 10**8] * 4)]
    ranges += [(50, at(0), at(400_000_000)), (51, at(10), at(10)), (52, at(9), at(3)), (53, None, at(9)), (54, points[0][1], points[0][1]), (55, at(-5), at(-5))]
    expected = {(i, k) for (i, x), (k, a, b) in product(points, ranges) if x and a and a <= x <= b}
    for bits in (1, 2, 3):
        got = range_join.range_join(spark.createDataFrame(points, "i int, x timestamp_ntz"), spark.createDataFrame(ranges, "k int, a timestamp_ntz, b timestamp_ntz"), "x", "a", "b", bits).collect()
        assert len(got) == len(expected) and {(r.i, r.k) for r in got} == expected


def test_many_points_of_a_range_join_are_not_broadcast(spark, monkeypatch):
    # the table is small, its rows times the levels are not
    points = spark.range(3000).selectExpr("id AS i", "CAST(id % 100 AS double) AS x")
    ranges = [("a", 0.0, 50.0), ("b", 20.0, 70.5), ("c", 70.5, 9999.0)]
    expected = sorted((i, n) for i in range(3000) for n, a, b in ranges if a <= i % 100 <= b)
    typed = spark.createDataFrame(ranges, "name string, a double, b double"), spark.sql("SELECT * FROM VALUES ('a', 0D, 50D), ('b', 20D, 70.5D), ('c', 70.5D, 9999D) AS r(name, a, b)")
    for few, rows, kind in ((range_join.FEW_NODES, 3000, "BuildRight"), (1, 3000, "SortMergeJoin"), (50, 2, "BuildLeft")):
        monkeypatch.setattr(range_join, "FEW_NODES", few)
        for small in typed:
            df = range_join.range_join(points.where(F.col("i") < rows), small, "x", "a", "b")
            assert sorted((r.i, r.name) for r in df.collect()) == [x for x in expected if x[0] < rows]
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert [x for x in ("BuildLeft", "BuildRight", "SortMergeJoin") if x in plan] == [kind]


def test_a_range_is_filed_at_few_nodes(spark):
    rng = random.Random(2)
    stretches = [(a := rng.randrange(1 << 30), min((1 << 30), a + rng.randrange(1 << rng.randrange(1, 30)))) for _ in range(50)] + [(0, 1 << 30), (5, 5), (0, 0), (1 << 30, 1 << 30)]
    df = spark.createDataFrame(stretches, "a long, b long")
    for bits in (1, 2):
        for r in df.select("a", "b", range_join._nodes("a", "b", bits, 30 // bits + 1).alias("n")).collect():
            blocks = sorted((x.place << bits * x.level, (x.place + 1 << bits * x.level) - 1) for x in r.n)
            assert blocks[0][0] == r.a and blocks[-1][1] == r.b and all(p[1] + 1 == q[0] for p, q in zip(blocks, blocks[1:], strict=False))
            assert len(blocks) <= 2 * ((1 << bits) - 1) * (30 // bits + 1)


def test_numbers_far_apart_in_ranges(spark):
    points = [(0.0,), (-1e308,), (1e308,), (1e-300,), (3.5,), (float("nan"),), (None,)]
    ranges = [("all", -1e308, 1e308), ("one", 3.5, 3.5), ("low", -1e308, 0.0)]
    got = range_join.range_join(spark.createDataFrame(points, "x double"), spark.createDataFrame(ranges, "name string, a double, b double"), "x", "a", "b").collect()
    expected = sorted((x, n) for (x,), (n, a, b) in product(points, ranges) if x is not None and a <= x <= b)
    assert sorted((r.x, r.name) for r in got) == expected
    empty = spark.createDataFrame([], "name string, a double, b double")
    assert range_join.range_join(spark.createDataFrame(points, "x double"), empty, "x", "a", "b").count() == 0


def test_texts_that_hold_keywords(spark):
    rng = random.Random(9)
    made = lambda n: "".join(rng.choice("aab é%_x") for _ in range(n))
    texts = [(i, made(rng.randrange(0, 15))) for i in range(60)] + [(60, None), (61, ""), (62, "\U0001f600ab\U0001f600"), (0, "aab")]
    words = [(made(rng.randrange(1, 6)),) for _ in range(40)] + [("",), (None,), ("aab",), ("aab",), ("\U0001f600",), ("zzz",), ("aaz",)]
    expected = sorted((i, w) for (i, t), (w,) in product(texts, words) if t is not None and w is not None and w in t)
    left, right = spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(words, "w string")
    for q in (2, 3, 4):
        assert sorted((r.i, r.w) for r in fuzzy_join.contains_join(left, right, "t", "w", q).collect()) == expected
    few = fuzzy_join.contains_join(left, right.where("w <> ''"), "t", "w")
    assert sorted((r.i, r.w) for r in few.collect()) == [x for x in expected if x[1]]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert fuzzy_join.contains_join(left, right.limit(0), "t", "w").count() == 0


@pytest.mark.parametrize(("stretches", "few"), [(1024, 1 << 16), (4, 3), (2, 1)])
def test_quantiles_with_a_value_far_off(spark, stretches, few):
    rng = random.Random(1)
    values = {"a": [rng.randrange(50) / 4 for _ in range(200)] + [1e300], "b": [rng.random() * 2.0**-rng.randrange(60) for _ in range(90)], "c": [5.0], "d": [1.0, 2.0], "e": [7.0] * 30, "f": [-1e308, 1e308, 0.0, 1.0]}
    df = spark.createDataFrame([(k, v) for k, x in values.items() for v in x] + [("a", None), (None, 1.0), ("g", None)], "k string, v double")
    shares = {"low": 0.0, "q1": 0.25, "med": 0.5, "odd": 0.9, "top": 1.0}
    got = {r.k: r for r in quantiles.quantiles(df, "k", "v", shares, stretches, few).collect()}
    assert set(got) == set(values)
    for k, x in values.items():
        x = sorted(x)
        for name, p in shares.items():
            at = p * (len(x) - 1)
            a, b = int(at), -int(-at // 1)
            expected = x[a] if a == b else (b - at) * x[a] + (at - a) * x[b]
            assert got[k][name] == pytest.approx(expected, rel=1e-12), (k, name)


def test_quantiles_of_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", v) for v in [-inf, 1.0, 2.0, 3.0, 4.0, 5.0, inf]], "k string, v double")
    got = quantiles.quantiles(df, "k", "v", {"low": 0.0, "med": 0.5, "top": 1.0}, 2, 1).first()
    assert (got.low, got.med, got.top) == (-inf, 3.0, inf)
    assert quantiles.quantiles(df.limit(0), "k", "v", {"med": 0.5}).count() == 0
