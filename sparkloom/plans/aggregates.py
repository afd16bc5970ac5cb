"""Aggregation."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rewrites import group_concat
from ..operators.quantiles import quantiles
from .registry import query


@query("agg01_count", "SELECT count(*) AS n FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count("*").alias("n"))


@query("agg02_count_distinct", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))


@query("agg03_basic", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 2) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 2).alias("avg_price"), F.min("l_discount").alias("min_disc"), F.max("l_tax").alias("max_tax"), F.count("*").alias("n"))


@query("agg04_group_by_expression", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY year(o_orderdate), o_orderstatus")
def _(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").agg(F.count("*").alias("n"))


@query("agg05_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 5 AND sum(o_totalprice) > 1000000")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s")).where("n > 5 AND s > 1000000").select("o_custkey", "n", F.round("s", 2).alias("total"))


@query("agg06_rollup", "SELECT r.r_name, n.n_name, count(*) AS customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ROLLUP (r.r_name, n.n_name)")
def _(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).rollup("r_name", "n_name").agg(F.count("*").alias("customers"))


@query("agg06_with_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(t):
    return t.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY o_orderstatus, o_orderpriority WITH ROLLUP")


@query("agg07_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("agg08_grouping_sets", "SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_size), ())")
def _(t):
    return t.part.groupingSets([["p_brand", "p_type"], ["p_size"], []], "p_brand", "p_type", "p_size").agg(F.count("*").alias("n")).select("p_brand", "p_type", "p_size", "n")


@query("agg09_grouping", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS TINYINT) AS g_flag, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").alias("g_flag"), F.grouping_id().alias("gid"), F.count("*").alias("n"))


@query("agg10_group_concat", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def _(t):
    return t.nation.groupBy("n_regionkey").agg(group_concat(F.col("n_name"), F.col("n_name"), "; ").alias("names"))


@query("agg10_listagg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey")
def _(t):
    return t.sql("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_nationkey DESC) AS names FROM {nation} GROUP BY n_regionkey")


@query("agg11_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS large FROM orders GROUP BY o_orderpriority")
def _(t):
    return t.sql("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS large FROM {orders} GROUP BY o_orderpriority")


@query("agg12_conditional", "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open FROM orders GROUP BY o_custkey")
def _(t):
    n = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, 1).otherwise(0))
    return t.orders.groupBy("o_custkey").agg(n("F").alias("finished"), n("O").alias("open"))


@query("agg13_stddev", "SELECT p_brand, round(stddev_samp(p_retailprice), 4) AS samp, round(stddev_pop(p_retailprice), 4) AS pop FROM part GROUP BY p_brand")
def _(t):
    return t.part.groupBy("p_brand").agg(F.round(F.stddev_samp("p_retailprice"), 4).alias("samp"), F.round(F.stddev_pop("p_retailprice"), 4).alias("pop"))


@query("agg14_variance", "SELECT p_type, round(var_samp(p_size), 4) AS samp, round(var_pop(p_size), 4) AS pop FROM part GROUP BY p_type")
def _(t):
    return t.part.groupBy("p_type").agg(F.round(F.var_samp("p_size"), 4).alias("samp"), F.round(F.var_pop("p_size"), 4).alias("pop"))


@query("agg15_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.covar_pop("l_quantity", "l_discount"), 6).alias("cp"), F.round(F.covar_samp("l_quantity", "l_tax"), 6).alias("cs"))


@query("agg16_regression", "SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 4) AS avgx, round(regr_avgy(l_extendedprice, l_quantity), 2) AS avgy FROM lineitem GROUP BY l_linestatus")
def _(t):
    y, x = "l_extendedprice", "l_quantity"
    return t.lineitem.groupBy("l_linestatus").agg(F.round(F.regr_slope(y, x), 3).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"), F.regr_count(y, x).alias("n"), F.round(F.regr_avgx(y, x), 4).alias("avgx"), F.round(F.regr_avgy(y, x), 2).alias("avgy"))


@query("agg17_percentiles", "SELECT p_type, percentile_cont(0.25) WITHIN GROUP (ORDER BY p_retailprice) AS q1, percentile_cont(0.5) WITHIN GROUP (ORDER BY p_retailprice) AS q2, percentile_cont(0.75) WITHIN GROUP (ORDER BY p_retailprice) AS q3 FROM part GROUP BY p_type")
def _(t):
    return t.sql("SELECT p_type, percentile_cont(0.25) WITHIN GROUP (ORDER BY p_retailprice) AS q1, percentile_cont(0.5) WITHIN GROUP (ORDER BY p_retailprice) AS q2, percentile_cont(0.75) WITHIN GROUP (ORDER BY p_retailprice) AS q3 FROM {part} GROUP BY p_type")


@query("agg18_median", "SELECT o_orderstatus, median(o_totalprice) AS med FROM orders GROUP BY o_orderstatus")
def _(t):
    # three keys: a plain median would hold a third of all values in one task
    return quantiles(t.orders, "o_orderstatus", "o_totalprice", {"med": 0.5})


@query("agg19_zscore_outliers", "SELECT p_partkey, p_type FROM (SELECT *, avg(p_retailprice) OVER (PARTITION BY p_type) AS m, stddev_samp(p_retailprice) OVER (PARTITION BY p_type) AS s FROM part) WHERE abs(p_retailprice - m) > 1.6 * s")
def _(t):
    # statistics are pre-aggregated and joined: a window would bring each type's rows together
    stats = t.part.groupBy("p_type").agg(F.avg("p_retailprice").alias("m"), F.stddev_samp("p_retailprice").alias("s"))
    return t.part.join(stats, "p_type").where(F.abs(F.col("p_retailprice") - F.col("m")) > 1.6 * F.col("s")).select("p_partkey", "p_type")


@query("agg19_iqr_outliers", "SELECT o.o_orderkey FROM orders o JOIN (SELECT o_orderpriority AS p, percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS q1, percentile_cont(0.75) WITHIN GROUP (ORDER BY o_totalprice) AS q3 FROM orders GROUP BY o_orderpriority) q ON o.o_orderpriority = q.p WHERE o.o_totalprice < q1 - 0.3 * (q3 - q1) OR o.o_totalprice > q3 + 0.3 * (q3 - q1)")
def _(t):
    q = quantiles(t.orders, "o_orderpriority", "o_totalprice", {"q1": 0.25, "q3": 0.75})
    x, reach = F.col("o_totalprice"), 0.3 * (F.col("q3") - F.col("q1"))
    return t.orders.join(q, "o_orderpriority").where((x < F.col("q1") - reach) | (x > F.col("q3") + reach)).select("o_orderkey")


@query("agg20_pivot", "SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS o, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 2) AS f FROM lineitem GROUP BY l_returnflag")
def _(t):
    wide = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity"))
    return wide.select("l_returnflag", F.round("O", 2).alias("o"), F.round("F", 2).alias("f"))


@query("agg21_unpivot", "SELECT p_partkey, measure, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (value FOR measure IN (size, price))")
def _(t):
    return t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).unpivot("p_partkey", ["size", "price"], "measure", "value")


@query("agg22_cooccurrence", "SELECT a.l_suppkey AS first_supp, b.l_suppkey AS second_supp, count(*) AS together FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY a.l_suppkey, b.l_suppkey HAVING count(*) >= 12")
def _(t):
    # an order has a handful of lines, so its pairs are few
    once = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    a, b = once.withColumnRenamed("l_suppkey", "first_supp"), once.withColumnRenamed("l_suppkey", "second_supp")
    return a.join(b, "l_orderkey").where("first_supp < second_supp").groupBy("first_supp", "second_supp").agg(F.count("*").alias("together")).where("together >= 12")


@query("agg22_transitions", "SELECT prev, event_type AS next, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL GROUP BY prev, event_type")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("prev", F.lag("event_type").over(w)).where("prev IS NOT NULL").groupBy("prev", F.col("event_type").alias("next")).agg(F.count("*").alias("n"))
