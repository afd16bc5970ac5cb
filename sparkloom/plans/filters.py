"""Projections and predicates."""

from pyspark.sql import functions as F

from ..functions.rewrites import glob_match
from .registry import query


@query("prj01_select", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice")


@query("prj02_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("prj03_arithmetic", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity * l_extendedprice AS gross, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_quantity") * F.col("l_extendedprice")).alias("gross"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"))


@query("prj04_percentage", "SELECT o_orderstatus, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 4) AS pct FROM orders GROUP BY o_orderstatus")
def _(t):
    total = t.orders.agg(F.count("*").alias("total"))
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("o_orderstatus", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))


@query("flt01_equality", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'")
def _(t):
    return t.orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "1-URGENT")).select("o_orderkey")


@query("flt02_ranges", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderdate >= TIMESTAMP '1995-07-01' AND o_orderdate < TIMESTAMP '2000-01-01'")
def _(t):
    # ranges of values, not of keys: the share of orders is the same in every table
    span = (F.col("o_orderdate") >= F.lit("1995-07-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    return t.orders.where(F.col("o_totalprice").between(1000, 50000) & span).select("o_orderkey", "o_totalprice")


@query("flt03_and_or", "SELECT p_partkey FROM part WHERE (p_size < 10 OR p_size > 40) AND NOT (p_retailprice > 1500 AND p_brand = 'Brand#4')")
def _(t):
    return t.part.where(((F.col("p_size") < 10) | (F.col("p_size") > 40)) & ~((F.col("p_retailprice") > 1500) & (F.col("p_brand") == "Brand#4"))).select("p_partkey")


@query("flt04_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def _(t):
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_mktsegment")


@query("flt05_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 's%' AND p_name LIKE '%i%' AND p_name NOT LIKE '%ring'")
def _(t):
    return t.part.where(F.col("p_name").like("s%") & F.col("p_name").like("%i%") & ~F.col("p_name").like("%ring")).select("p_partkey", "p_name")


@query("flt06_ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%'")
def _(t):
    return t.customer.where(F.col("c_mktsegment").ilike("build%")).select("c_custkey")


@query("flt07_regexp", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(small|large) [a-m]')")
def _(t):
    return t.part.where(F.col("p_name").rlike("^(small|large) [a-m]")).select("p_partkey", "p_name")


@query("flt08_glob", "SELECT p_partkey, p_name FROM part WHERE p_name GLOB 's*[!a-m]i[nz]*' OR p_name GLOB '??? r?*'")
def _(t):
    return t.part.where(glob_match(F.col("p_name"), "s*[^a-m]i[nz]*") | glob_match(F.col("p_name"), "??? r?*")).select("p_partkey", "p_name")


@query("flt09_is_null", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS open_status FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL OR nullif(o_orderpriority, '1-URGENT') IS NOT NULL")
def _(t):
    status, priority = F.nullif(F.col("o_orderstatus"), F.lit("F")), F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))
    return t.orders.where(status.isNull() | priority.isNotNull()).select("o_orderkey", status.alias("open_status"))


@query("flt10_residual", "SELECT o.o_orderkey, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 20 * c.c_acctbal")
def _(t):
    return t.orders.join(t.customer, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > 20 * F.col("c_acctbal"))).select("o_orderkey", "c_custkey")
