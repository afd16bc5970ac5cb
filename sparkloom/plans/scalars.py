"""Scalar functions."""

from pyspark.sql import functions as F

from ..functions.rewrites import convert, iif, json_extract
from .registry import query


@query("str01_case_length", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS INTEGER) AS n FROM part")
def _(t):
    return t.part.select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_brand").alias("l"), F.length("p_name").alias("n"))


@query("str02_concat", "SELECT p_partkey, concat(p_brand, ' / ', p_type) AS a, p_name || '-' || CAST(p_size AS VARCHAR) AS b FROM part")
def _(t):
    return t.part.select("p_partkey", F.concat("p_brand", F.lit(" / "), "p_type").alias("a"), F.concat_ws("-", "p_name", F.col("p_size").cast("string")).alias("b"))


@query("str03_locate", "SELECT p_partkey, CAST(instr(p_name, 'i') AS INTEGER) AS at FROM part")
def _(t):
    return t.part.select("p_partkey", F.locate("i", F.col("p_name")).alias("at"))


@query("str04_multi_regexp", "SELECT p_partkey, regexp_extract(p_brand, '#(\\d+)', 1) AS number, regexp_matches(p_name, 'ring|bolt') AND regexp_matches(p_name, '^(red|blue)') AS hit FROM part")
def _(t):
    return t.part.select("p_partkey", F.regexp_extract("p_brand", r"#(\d+)", 1).alias("number"), (F.col("p_name").rlike("ring|bolt") & F.col("p_name").rlike("^(red|blue)")).alias("hit"))


@query("dat01_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(o_orderdate AS DATE) AS d FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.quarter("o_orderdate").alias("q"), F.to_date("o_orderdate").alias("d"))


@query("dat02_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("ym"))


@query("dat03_trunc", "SELECT event_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS h, CAST(date_trunc('week', ts) AS DATE) AS w FROM events")
def _(t):
    return t.events.select("event_id", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("h"), F.to_date(F.date_trunc("week", "ts")).alias("w"))


@query("dat04_extract", "SELECT event_id, CAST(extract(hour FROM ts) AS INTEGER) AS h, CAST(extract(doy FROM ts) AS INTEGER) AS doy FROM events")
def _(t):
    return t.events.select("event_id", F.extract(F.lit("hour"), "ts").alias("h"), F.extract(F.lit("doy"), "ts").alias("doy"))


@query("dat05_datediff", "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS INTEGER) AS days FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.datediff(F.lit("2001-12-31").cast("date"), F.to_date("o_orderdate")).alias("days"))


@query("dat06_date_arithmetic", "SELECT o_orderkey, CAST(o_orderdate - INTERVAL 10 DAY AS DATE) AS earlier, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS later FROM orders WHERE o_orderdate < now()")
def _(t):
    return t.sql("SELECT o_orderkey, CAST(o_orderdate - INTERVAL 10 DAY AS DATE) AS earlier, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS later FROM {orders} WHERE o_orderdate < now()")


@query("dat07_weekend", "SELECT o_orderkey, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS dow, dayofweek(o_orderdate) IN (0, 6) AS weekend FROM orders")
def _(t):
    d = F.dayofweek("o_orderdate")
    return t.orders.select("o_orderkey", d.alias("dow"), d.isin(1, 7).alias("weekend"))


@query("dat08_series", "SELECT CAST(d AS DATE) AS d, count(o_orderkey) AS n FROM generate_series(DATE '1996-01-01', DATE '1996-03-31', INTERVAL 1 DAY) s(d) LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(d AS DATE) GROUP BY d")
def _(t):
    days = t.spark.sql("SELECT explode(sequence(DATE'1996-01-01', DATE'1996-03-31', INTERVAL 1 DAY)) AS d")
    per_day = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("o_orderkey").alias("n"))
    return days.join(per_day, "d", "left").select("d", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("dat09_quarter_label", "SELECT o_orderkey, concat(year(o_orderdate), '-Q', quarter(o_orderdate)) AS label FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate")).alias("label"))


@query("mth01_rounding", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 0) AS r, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f FROM customer")
def _(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.abs(b).alias("a"), F.round(b, 0).alias("r"), F.ceil(b).alias("c"), F.floor(b).alias("f"))


@query("cnd01_case", "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'p' WHEN 'SMALL' THEN 's' ELSE 'x' END AS simple, CASE WHEN p_size < 10 THEN CASE WHEN p_retailprice > 1500 THEN 'small dear' ELSE 'small' END WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS nested FROM part")
def _(t):
    simple = F.when(F.col("p_type") == "PROMO", "p").when(F.col("p_type") == "SMALL", "s").otherwise("x")
    nested = F.when(F.col("p_size") < 10, F.when(F.col("p_retailprice") > 1500, "small dear").otherwise("small")).when(F.col("p_size") < 30, "middle").otherwise("large")
    return t.part.select("p_partkey", simple.alias("simple"), nested.alias("nested"))


@query("cnd02_null_functions", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'F'), 'done') AS status, ifnull(nullif(o_orderpriority, '5-LOW'), 'low') AS priority FROM orders")
def _(t):
    return t.orders.select("o_orderkey", iif(F.col("o_totalprice") > 100000, F.lit("big"), F.lit("small")).alias("size"), F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("F")), F.lit("done")).alias("status"), F.ifnull(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.lit("low")).alias("priority"))


@query("cnd03_casts", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, TRY_CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS BIGINT) AS n, TRY_CAST(p_name AS BIGINT) AS bad, CAST(trunc(p_retailprice) AS BIGINT) AS whole FROM part")
def _(t):
    return t.part.select("p_partkey", F.col("p_size").cast("string").alias("s"), convert(F.regexp_extract("p_brand", r"#(\d+)", 1), "signed").alias("n"), convert(F.col("p_name"), "signed").alias("bad"), F.col("p_retailprice").cast("bigint").alias("whole"))


@query("jsn01_json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(t):
    return t.events.select("event_id", json_extract(F.col("props"), "$.k").cast("int").alias("k"))
