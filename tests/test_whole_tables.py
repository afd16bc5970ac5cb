"""Queries over whole tables: each branch of their feature has rows, and more rows in give more rows out."""

import pytest

from sparkloom.plans import sets
from sparkloom.plans.surface import QUERIES


@pytest.mark.parametrize("name", ["jon04_full", "jon04_full_rewrite"])
def test_full_join_keeps_both_sides(name, spark, folder):
    rows = QUERIES[name](spark, folder).collect()
    orders, customers = (spark.read.parquet(f"{folder}/{n}.parquet").count() for n in ("orders", "customer"))
    assert len({r.o_orderkey for r in rows} - {None}) == orders
    assert len({r.c_custkey for r in rows} - {None}) == customers
    assert any(r.o_orderkey is None for r in rows) and any(r.c_custkey is None for r in rows)
    assert any(r.o_orderkey is not None and r.c_custkey is not None for r in rows)


def test_ranges_know_no_key(spark, folder, tmp_path):
    before = QUERIES["flt02_ranges"](spark, folder).count()
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    orders.withColumn("o_orderkey", orders.o_orderkey + 1_000_000_000).write.parquet(f"{tmp_path}/orders.parquet")
    assert QUERIES["flt02_ranges"](spark, str(tmp_path)).count() == before > 0


@pytest.mark.parametrize("rows_of_a_range", [7, 4096])
def test_every_order_is_ranked(rows_of_a_range, spark, folder, monkeypatch):
    monkeypatch.setattr(sets, "RANGE_ROWS", rows_of_a_range)
    rows = sorted(QUERIES["srt04_null_placement"](spark, folder).collect(), key=lambda r: r.r)
    orders = spark.read.parquet(f"{folder}/orders.parquet").collect()
    status = {o.o_orderkey: None if o.o_orderstatus == "F" else o.o_orderstatus for o in orders}
    assert [r.r for r in rows] == list(range(1, len(orders) + 1))
    right = sorted(k for k, s in status.items() if s)
    right.sort(key=lambda k: status[k], reverse=True)
    right += sorted(k for k, s in status.items() if s is None)
    assert [r.o_orderkey for r in rows] == right and rows[0].status and rows[-1].status is None
