"""Joins."""

from pyspark.sql import functions as F

from ..operators.fuzzy_join import contains_join
from ..operators.range_join import range_join
from .registry import query


@query("jon01_inner", "SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, p.p_name, p.p_brand FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey AND l.l_quantity > p.p_size")
def _(t):
    return t.lineitem.join(t.part, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_quantity") > F.col("p_size"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "p_brand")


@query("jon02_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
def _(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("jon03_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000")
def _(t):
    return t.orders.where("o_totalprice > 200000").join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "right").select("o_orderkey", "c_custkey")


@query("jon04_full", "SELECT c.c_custkey, o.o_orderkey FROM customer c FULL JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000")
def _(t):
    # both tables whole: cheap orders and customers without a dear one stand alone
    return t.customer.join(t.orders, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 400000), "full").select("c_custkey", "o_orderkey")


@query("jon04_full_rewrite", "SELECT c.c_custkey, o.o_orderkey FROM customer c FULL JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000")
def _(t):
    c, o = t.customer.select("c_custkey"), t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 400000)
    return c.join(o, on, "left").select("c_custkey", "o_orderkey").unionByName(o.join(c, on, "left_anti").select(F.lit(None).cast("bigint").alias("c_custkey"), "o_orderkey"))


@query("jon05_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
def _(t):
    # both are fixed tables of a few rows
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("jon06_range", "SELECT p.p_partkey, b.band FROM part p JOIN (VALUES (900.0, 1100.0, 'low'), (1050.0, 1400.0, 'middle'), (1400.0, 9999.0, 'high')) b(low, high, band) ON p.p_retailprice BETWEEN b.low AND b.high")
def _(t):
    bands = t.spark.createDataFrame([(900.0, 1100.0, "low"), (1050.0, 1400.0, "middle"), (1400.0, 9999.0, "high")], "low double, high double, band string")
    # ranges are filed at nodes of an interval tree, so the join is an equi-join of any size
    return range_join(t.part, bands, "p_retailprice", "low", "high").select("p_partkey", "band")


@query("jon06_range_dates", "SELECT e.event_id, w.label FROM events e JOIN (VALUES (TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-10', 'a'), (TIMESTAMP '2024-01-05', TIMESTAMP '2024-02-01', 'b')) w(start_at, end_at, label) ON e.ts BETWEEN w.start_at AND w.end_at")
def _(t):
    spans = t.spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-10', 'a'), (timestamp_ntz'2024-01-05', timestamp_ntz'2024-02-01', 'b') AS w(start_at, end_at, label)")
    return range_join(t.events, spans, "ts", "start_at", "end_at").select("event_id", "label")


@query("jon07_fuzzy", "SELECT p.p_partkey, k.word FROM part p JOIN (VALUES ('ring'), ('bolt'), ('small'), ('gear')) k(word) ON p.p_name LIKE concat('%', k.word, '%')")
def _(t):
    words = t.spark.createDataFrame([("ring",), ("bolt",), ("small",), ("gear",)], "word string")
    return contains_join(t.part, words, "p_name", "word").select("p_partkey", "word")


@query("jon07_fuzzy_words", "SELECT p.p_partkey, k.word FROM part p JOIN (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM documents) k ON p.p_name LIKE concat('%', k.word, '%')")
def _(t):
    # names of parts against all words of all documents: both sides grow with the data
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return contains_join(t.part, words, "p_name", "word").select("p_partkey", "word")


SPANS = "SELECT l_partkey, l_suppkey, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at FROM {lineitem} GROUP BY l_partkey, l_suppkey"


@query("jon06_range_spans", f"SELECT l_partkey, l_suppkey, count(*) AS n, min(o_orderkey) AS first_order FROM orders JOIN ({SPANS.format(lineitem='lineitem')}) s ON o_orderdate BETWEEN first_at AND last_at WHERE o_totalprice > 490000 GROUP BY l_partkey, l_suppkey")
def _(t):
    # dear orders placed while a supplier shipped a part: spans from a moment to many years in one join
    met = range_join(t.orders.where("o_totalprice > 490000").select("o_orderkey", "o_orderdate"), t.sql(SPANS), "o_orderdate", "first_at", "last_at")
    return met.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


@query("jon08_self", "SELECT a.n_name AS first_name, b.n_name AS second_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("first_name"), F.col("b.n_name").alias("second_name"))


@query("jon09_revenue_by_region", "SELECT r.r_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, count(*) AS n FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY r.r_name")
def _(t):
    wide = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return wide.groupBy("r_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("jon10_anti", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P' WHERE o.o_orderkey IS NULL")
def _(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("jon11_semi", "SELECT p.p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 48)")
def _(t):
    return t.part.join(t.lineitem.where("l_quantity > 48"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")
