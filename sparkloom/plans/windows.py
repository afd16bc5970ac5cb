"""Window functions. Every order has a unique last key, so that results are fixed."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import ranked
from .registry import query


def by_customer():
    return W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


def by_price():
    return W.partitionBy("p_type").orderBy("p_retailprice", "p_partkey")


def price_ties():
    return W.partitionBy("p_type").orderBy("p_size")


def _ranked(name: str, sql: str, column, window):
    @query(name, f"SELECT p_partkey, {sql} AS r FROM part")
    def _(t):
        return t.part.select("p_partkey", column().over(window()).alias("r"))


_ranked("win01_row_number", "CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS INTEGER)", F.row_number, by_price)
_ranked("win02_rank", "CAST(rank() OVER (PARTITION BY p_type ORDER BY p_size) AS INTEGER)", F.rank, price_ties)
_ranked("win03_dense_rank", "CAST(dense_rank() OVER (PARTITION BY p_type ORDER BY p_size) AS INTEGER)", F.dense_rank, price_ties)
_ranked("win04_percent_rank", "percent_rank() OVER (PARTITION BY p_type ORDER BY p_size)", F.percent_rank, price_ties)
_ranked("win05_cume_dist", "cume_dist() OVER (PARTITION BY p_type ORDER BY p_size)", F.cume_dist, price_ties)
_ranked("win06_ntile", "CAST(ntile(4) OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS INTEGER)", lambda: F.ntile(4), by_price)


def _ordered(name: str, sql: str, column):
    @query(name, f"SELECT o_orderkey, {sql} AS x FROM orders")
    def _(t):
        return t.orders.select("o_orderkey", column().alias("x"))


OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_ordered("win07_lag", f"lag(o_totalprice, 2, 0.0) {OVER})", lambda: F.lag("o_totalprice", 2, 0.0).over(by_customer()))
_ordered("win08_lead", f"lead(o_orderstatus) {OVER})", lambda: F.lead("o_orderstatus").over(by_customer()))
_ordered("win09_first_value", f"first_value(o_totalprice) {OVER})", lambda: F.first_value("o_totalprice").over(by_customer()))
_ordered("win10_last_value", f"last_value(o_totalprice) {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", lambda: F.last_value("o_totalprice").over(by_customer().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
_ordered("win11_nth_value", f"nth_value(o_totalprice, 3) {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", lambda: F.nth_value("o_totalprice", 3).over(by_customer().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
_ordered("win12_moving_average", f"round(avg(o_totalprice) {OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 3)", lambda: F.round(F.avg("o_totalprice").over(by_customer().rowsBetween(-2, 0)), 3))
_ordered("win13_running_total", f"round(sum(o_totalprice) {OVER} ROWS UNBOUNDED PRECEDING), 2)", lambda: F.round(F.sum("o_totalprice").over(by_customer().rowsBetween(W.unboundedPreceding, 0)), 2))
_ordered("win14_moving_sum", f"round(sum(o_totalprice) {OVER} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2)", lambda: F.round(F.sum("o_totalprice").over(by_customer().rowsBetween(-1, 1)), 2))


LINES = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


@query("win13_running_of_all", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (ORDER BY {LINES}) AS r, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (ORDER BY {LINES} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shipped FROM lineitem")
def _(t):
    # one order over the whole table: a scan over ranges of it, no window without a partition
    columns = LINES.split(", ")
    rows = t.lineitem.select(*columns, F.col("l_quantity").cast("long").alias("units"))
    return ranked(rows, [F.asc_nulls_last(c) for c in columns], "r", {"shipped": "units"}).drop("l_shipdate", "units")


def _preceding(name: str, interval: str) -> None:
    body = f"SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL {interval} PRECEDING AND CURRENT ROW) AS n FROM "

    @query(name, body + "orders")
    def _(t):
        return t.sql(body + "{orders}")


_preceding("win15_range_days", "30 DAY")
_preceding("win15_range_month", "1 MONTH")


@query("win16_share", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(W.partitionBy("o_custkey")), 6).alias("share"))


@query("win17_period_over_period", """
WITH m AS (SELECT date_trunc('month', o_orderdate) AS mon, sum(o_totalprice) AS s FROM orders GROUP BY 1),
d AS (SELECT unnest(generate_series((SELECT min(mon) FROM m), (SELECT max(mon) FROM m), INTERVAL 1 MONTH)) AS mon)
SELECT strftime(d.mon, '%Y-%m') AS mon, round(coalesce(s, 0), 2) AS total, round(lag(coalesce(s, 0), 1) OVER (ORDER BY d.mon), 2) AS last_month, round(lag(coalesce(s, 0), 12) OVER (ORDER BY d.mon), 2) AS last_year FROM d LEFT JOIN m USING (mon)""")
def _(t):
    # one row a month is left after the aggregation; months without orders are filled in
    m = t.orders.groupBy(F.date_trunc("month", "o_orderdate").alias("mon")).agg(F.sum("o_totalprice").alias("s"))
    d = m.agg(F.min("mon").alias("a"), F.max("mon").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("mon"))
    s, w = F.coalesce("s", F.lit(0.0)), W.orderBy("mon")
    return d.join(m, "mon", "left").select(F.date_format("mon", "yyyy-MM").alias("mon"), F.round(s, 2).alias("total"), F.round(F.lag(s, 1).over(w), 2).alias("last_month"), F.round(F.lag(s, 12).over(w), 2).alias("last_year"))


@query("win18_top_n_per_group", "SELECT p_type, p_partkey, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def _(t):
    w = W.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return t.part.withColumn("r", F.row_number().over(w)).where("r <= 3").select("p_type", "p_partkey", "r")


@query("win18_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(t):
    # max_by aggregates before the shuffle, unlike a ranking
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return t.events.groupBy("user_id").agg(last.alias("e")).select("user_id", "e.event_id", "e.event_type")


@query("win19_status_changes", "SELECT o_orderkey, prev, o_orderstatus FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) WHERE prev <> o_orderstatus")
def _(t):
    return t.orders.withColumn("prev", F.lag("o_orderstatus").over(by_customer())).where("prev <> o_orderstatus").select("o_orderkey", "prev", "o_orderstatus")


@query("win20_event_gaps", "SELECT event_id, gap FROM (SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) WHERE gap > 36000000000")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gaps = t.events.select("event_id", "ts", F.lag("ts").over(w).alias("before"))
    return gaps.select("event_id", F.timestamp_diff("microsecond", "before", "ts").alias("gap")).where("gap > 36000000000")


@query("win21_moving_stddev", "SELECT event_id, round(stddev_samp(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 4) AS sd FROM events")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, 0)
    return t.events.select("event_id", F.round(F.stddev_samp("value").over(w), 4).alias("sd"))


@query("win21_decomposition", """
WITH d AS (SELECT CAST(ts AS DATE) AS d, sum(value) AS x FROM events GROUP BY 1),
r AS (SELECT d, x, avg(x) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM d),
s AS (SELECT *, avg(x - trend) OVER (PARTITION BY dayofweek(d)) AS seasonal FROM r)
SELECT d, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(x - trend - seasonal, 3) AS residual FROM s""")
def _(t):
    d = t.events.groupBy(F.to_date("ts").alias("d")).agg(F.sum("value").alias("x"))
    r = d.withColumn("trend", F.avg("x").over(W.orderBy("d").rowsBetween(-3, 3)))
    s = r.withColumn("seasonal", F.avg(F.col("x") - F.col("trend")).over(W.partitionBy(F.dayofweek("d"))))
    return s.select("d", F.round("trend", 3).alias("trend"), F.round("seasonal", 3).alias("seasonal"), F.round(F.col("x") - F.col("trend") - F.col("seasonal"), 3).alias("residual"))
