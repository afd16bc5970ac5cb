"""Order, limits, set operations and subqueries."""

from pyspark.sql import functions as F

from ..functions.rewrites import to_spark_sql
from ..operators.ordered import RANGE_ROWS, ranked
from .registry import query



@query("srt01_order_by", "SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name ASC")
def _(t):
    return t.nation.orderBy(F.desc("n_regionkey"), F.asc("n_name")).select("n_regionkey", "n_name")


@query("srt02_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def _(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(10).select("o_orderkey")


@query("srt03_top_n", "SELECT * FROM (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) UNION ALL SELECT * FROM (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10)")
def _(t):
    c = t.customer.select("c_custkey", "c_acctbal")
    return c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).unionByName(c.orderBy("c_acctbal", "c_custkey").limit(10))


@query("srt04_null_placement", "SELECT o_orderkey, status, row_number() OVER (ORDER BY status DESC NULLS LAST, o_orderkey) AS r FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders)")
def _(t):
    # every order's rank without one task for all orders: rows dealt by ranges of the order, and a scan over the ranges
    rows = t.orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status"))
    return ranked(rows, [F.desc_nulls_last("status"), F.asc("o_orderkey")], "r", range_rows=RANGE_ROWS)


@query("set01_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("set02_union_all", "SELECT c_custkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("k"), F.lit("customer").alias("kind")).unionByName(t.supplier.select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("kind")))


@query("set03_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def _(t):
    return t.orders.select(F.col("o_custkey").alias("k")).intersect(t.customer.where("c_acctbal > 5000").select("c_custkey"))


@query("set03_intersect_rewrite", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def _(t):
    return t.sql("SELECT DISTINCT o_custkey AS k FROM {orders} o WHERE EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 5000)")


@query("set04_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("set04_except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
def _(t):
    return t.nation.select(F.col("n_regionkey").alias("k")).exceptAll(t.region.select("r_regionkey"))


@query("sub01_scalar", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders, (SELECT max(o_totalprice) FROM orders) AS top FROM customer c")
def _(t):
    return t.sql("SELECT c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS n_orders, (SELECT max(o_totalprice) FROM {orders}) AS top FROM {customer} c")


@query("sub02_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    return t.sql("SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING') AND o_orderkey NOT IN (SELECT l_orderkey FROM {lineitem} WHERE l_quantity > 45)")


@query("sub03_exists", "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_discount > 0.09) AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity = 50 AND l.l_tax = 0.08)")
def _(t):
    on = F.col("l_suppkey") == F.col("s_suppkey")
    return t.supplier.join(t.lineitem.where("l_discount > 0.09"), on, "left_semi").join(t.lineitem.where("l_quantity = 50 AND l_tax = 0.08"), on, "left_anti").select("s_suppkey")


@query("sub04_correlated", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_type = p.p_type)")
def _(t):
    return t.sql("SELECT p_partkey FROM {part} p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM {part} q WHERE q.p_type = p.p_type)")


@query("sub05_derived_table", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("customers"))


@query("sub06_all_any", "SELECT p_partkey, 'all' AS kind FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size < 5) UNION ALL SELECT p_partkey, 'any' FROM part WHERE p_size = ANY (SELECT p_size FROM part WHERE p_retailprice > 1990)")
def _(t):
    sql = to_spark_sql("SELECT p_partkey, 'all' AS kind FROM part p WHERE p.p_retailprice > ALL (SELECT q.p_retailprice FROM part q WHERE q.p_size < 5) UNION ALL SELECT p_partkey, 'any' FROM part p WHERE p.p_size = ANY (SELECT q.p_size FROM part q WHERE q.p_retailprice > 1990)")
    return t.sql(sql.replace("FROM part", "FROM {part}"))


@query("sub07_nested", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity > 40))")
def _(t):
    lines = t.lineitem.where("l_discount >= 0.1 AND l_quantity > 40")
    big = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")
