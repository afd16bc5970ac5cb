"""Partitions of a JDBC table, through the database that ships with Spark."""

import pytest

from sparkloom.sources.jdbc import jdbc_by_key, key_ranges

URL = "jdbc:derby:memory:shop;create=true"


@pytest.fixture(scope="module")
def uneven(spark):
    """Keys that lie close together, one very far off, some missing."""
    rows = [(i, i % 7, f"n{i}") for i in range(1, 2001)] + [(4 * 10**18, 1, "far"), (-5 * 10**17, 2, "below")] + [(None, 3, "none")] * 5
    df = spark.createDataFrame(rows, "k long, g int, name string")
    df.write.jdbc(URL, "uneven", mode="overwrite")
    df.limit(0).write.jdbc(URL, "nothing", mode="overwrite")
    return rows


def test_ranges_follow_the_rows(spark, uneven):
    found = key_ranges(spark, URL, "uneven", "k", 8)
    assert sum(n for _, _, n in found) == 2002 and all(a <= b for a, b, _ in found)
    assert all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))
    assert max(n for _, _, n in found) <= -(-2002 // 8) and len(found) <= 16
    assert key_ranges(spark, URL, "nothing", "k", 8) == []


def test_every_row_is_read_once_in_balanced_partitions(spark, uneven):
    df = jdbc_by_key(spark, URL, "uneven", "k", 8)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, uneven))
    sizes = df.rdd.glom().map(len).collect()
    assert sum(sizes) == len(uneven) and max(sizes) <= 251
    assert jdbc_by_key(spark, URL, "nothing", "k").count() == 0
    one = jdbc_by_key(spark, URL, "uneven", "k", 1)
    assert one.count() == len(uneven) and one.rdd.getNumPartitions() == 2


def test_filters_and_columns_reach_the_database(spark, uneven):
    df = jdbc_by_key(spark, URL, "uneven", "k", 4).where("g = 3 AND k > 100").select("k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(g), *IsNotNull(k), *EqualTo(g,3), *GreaterThan(k,100)], ReadSchema: struct<k:bigint>" in plan
    assert sorted(r[0] for r in df.collect()) == sorted(k for k, g, _ in uneven if g == 3 and k and k > 100)
