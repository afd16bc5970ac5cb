"""Common table expressions, recursion and graphs.

Hierarchies hang suppliers under suppliers by arithmetic on their keys. Graphs are
drawn from orders: which supplier follows which within them, which parts go together,
how a customer's orders come one after another, how much nations trade. Whole tables go
through operators.closure and operators.graphs, which iterate with checkpoints; a few
queries show Spark's WITH RECURSIVE on small stated edge lists.
"""

from pyspark.sql import functions as F

from ..operators.closure import levels, rolled_up, shortest_paths
from ..operators.graphs import chains, cyclic_components, explosion
from .registry import query

TREE = "SELECT s_suppkey AS id, CASE WHEN s_suppkey <= 1 THEN NULL ELSE greatest(1, CAST(floor((s_suppkey - 1) / 3) AS BIGINT)) END AS parent, s_acctbal AS amount FROM {supplier}"
DUCK_TREE = TREE.format(supplier="supplier")
EDGES = "(VALUES (1, 2, 4), (1, 3, 1), (3, 2, 2), (2, 4, 5), (3, 4, 9), (4, 1, 3), (4, 5, 1), (6, 7, 2)) AS e(src, dst, dist)"


@query("cte01_single", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_custkey, round(s, 2) AS s FROM customer JOIN big ON c_custkey = o_custkey WHERE s > 2000000")
def _(t):
    return t.sql("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM {orders} GROUP BY o_custkey) SELECT c_custkey, round(s, 2) AS s FROM {customer} JOIN big ON c_custkey = o_custkey WHERE s > 2000000")


@query("cte02_chained", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS m FROM a GROUP BY n) SELECT n, m FROM b WHERE m > (SELECT avg(m) FROM b)")
def _(t):
    return t.sql("WITH a AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey), b AS (SELECT n, count(*) AS m FROM a GROUP BY n) SELECT n, m FROM b WHERE m > (SELECT avg(m) FROM b)")


@query("cte03_hierarchy", f"WITH RECURSIVE t AS ({DUCK_TREE}), h AS (SELECT id, parent, 0 AS level, CAST(id AS VARCHAR) AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.id, t.parent, h.level + 1, h.path || '/' || CAST(t.id AS VARCHAR) FROM h JOIN t ON t.parent = h.id) SELECT id, parent, level, path FROM h")
def _(t):
    # levels are as many as the tree is deep: beyond the limits of recursive SQL in a large table
    return levels(t.sql(TREE))


@query("cte04_dependency_paths", f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), p AS (SELECT dst AS node, [src, dst] AS path FROM e WHERE src = 1 UNION ALL SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.node WHERE NOT list_contains(p.path, e.dst)) SELECT node, array_to_string(path, '>') AS path FROM p")
def _(t):
    return t.sql(f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), p AS (SELECT dst AS node, array(src, dst) AS path FROM e WHERE src = 1 UNION ALL SELECT e.dst, array_append(p.path, e.dst) FROM p JOIN e ON e.src = p.node WHERE NOT array_contains(p.path, e.dst)) SELECT node, array_join(transform(path, x -> CAST(x AS STRING)), '>') AS path FROM p")


CHAIN = "(VALUES (1, NULL, 'ann', 10), (2, 1, 'bob', 4), (3, 2, 'cho', 7), (4, 3, 'dee', 2), (5, 2, 'eli', 9)) AS s(step, before, who, hours)"


@query("cte05_approval_chain", f"WITH RECURSIVE s AS (SELECT * FROM {CHAIN}), c AS (SELECT step, who, hours AS total, who AS path FROM s WHERE before IS NULL UNION ALL SELECT s.step, s.who, c.total + s.hours, c.path || ' > ' || s.who FROM c JOIN s ON s.before = c.step) SELECT step, total, path FROM c")
def _(t):
    return t.sql(f"WITH RECURSIVE s AS (SELECT * FROM {CHAIN}), c AS (SELECT step, who, hours AS total, CAST(who AS STRING) AS path FROM s WHERE before IS NULL UNION ALL SELECT s.step, s.who, c.total + s.hours, c.path || ' > ' || s.who FROM c JOIN s ON s.before = c.step) SELECT step, total, path FROM c")


PARTS = "(VALUES ('bike', 'wheel', 2), ('bike', 'frame', 1), ('wheel', 'spoke', 32), ('wheel', 'rim', 1), ('frame', 'tube', 3), ('rim', 'bolt', 4), ('frame', 'bolt', 6)) AS b(whole, piece, n)"


@query("cte06_explosion", f"WITH RECURSIVE b AS (SELECT * FROM {PARTS}), x AS (SELECT piece, n FROM b WHERE whole = 'bike' UNION ALL SELECT b.piece, x.n * b.n FROM x JOIN b ON b.whole = x.piece) SELECT piece, CAST(sum(n) AS BIGINT) AS needed FROM x GROUP BY piece")
def _(t):
    return t.sql(f"WITH RECURSIVE b AS (SELECT * FROM {PARTS}), x AS (SELECT piece, n FROM b WHERE whole = 'bike' UNION ALL SELECT b.piece, x.n * b.n FROM x JOIN b ON b.whole = x.piece) SELECT piece, sum(n) AS needed FROM x GROUP BY piece")


@query("cte07_shortest_path", f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), p AS (SELECT 1 AS node, 0 AS cost, 0 AS hops UNION ALL SELECT e.dst, p.cost + e.dist, p.hops + 1 FROM p JOIN e ON e.src = p.node WHERE p.hops < 10) SELECT node, CAST(min(cost) AS BIGINT) AS cost FROM p GROUP BY node")
def _(t):
    edges = t.spark.sql(f"SELECT src, dst, dist FROM {EDGES}")
    return shortest_paths(edges, t.spark.range(1, 2).select(F.col("id").cast("int").alias("node")), hops=10)


@query("cte08_cycles", f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), p AS (SELECT src AS start, dst AS node, [src, dst] AS path, src = dst AS cycle FROM e UNION ALL SELECT p.start, e.dst, list_append(p.path, e.dst), e.dst = p.start FROM p JOIN e ON e.src = p.node WHERE NOT p.cycle AND (e.dst = p.start OR NOT list_contains(p.path, e.dst))) SELECT start, array_to_string(path, '>') AS path FROM p WHERE cycle")
def _(t):
    return t.sql(f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), p AS (SELECT src AS start, dst AS node, array(src, dst) AS path, src = dst AS cycle FROM e UNION ALL SELECT p.start, e.dst, array_append(p.path, e.dst), e.dst = p.start FROM p JOIN e ON e.src = p.node WHERE NOT p.cycle AND (e.dst = p.start OR NOT array_contains(p.path, e.dst))) SELECT start, array_join(transform(path, x -> CAST(x AS STRING)), '>') AS path FROM p WHERE cycle")


@query("cte09_roll_up", f"WITH RECURSIVE t AS ({DUCK_TREE}), c AS (SELECT id AS top, id FROM t UNION ALL SELECT c.top, t.id FROM c JOIN t ON t.parent = c.id) SELECT top AS id, count(*) AS n, round(sum(t.amount), 2) AS total FROM c JOIN t ON c.id = t.id GROUP BY top")
def _(t):
    return rolled_up(t.sql(TREE)).select("id", "n", F.round("total", 2).alias("total"))


#: Nations as a graph: an edge from a customer's to a supplier's nation where more orders run between them than on average, its length the number of orders short of the most.
TRADE = "SELECT src, dst, top + 1 - n AS dist FROM (SELECT src, dst, n, max(n) OVER () AS top, sum(n) OVER () AS total, count(*) OVER () AS lanes FROM (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' GROUP BY c_nationkey, s_nationkey) e) f WHERE src <> dst AND n * lanes > total"
DUCK_TRADE = TRADE.format(lineitem="lineitem", orders="orders", customer="customer", supplier="supplier")


@query("cte07_shortest_trade_path", f"WITH RECURSIVE e AS ({DUCK_TRADE}), p AS (SELECT 0 AS node, 0::BIGINT AS cost, 0 AS hops UNION ALL SELECT node, min(cost), hops FROM (SELECT e.dst AS node, p.cost + e.dist AS cost, p.hops + 1 AS hops FROM p JOIN e ON e.src = p.node WHERE p.hops < 6) GROUP BY node, hops) SELECT node, CAST(min(cost) AS BIGINT) AS cost FROM p GROUP BY node")
def _(t):
    edges = t.sql(TRADE).select("src", "dst", F.col("dist").cast("long").alias("dist"))
    return shortest_paths(edges, t.spark.range(1).select(F.col("id").cast("int").alias("node")), hops=6)


#: Suppliers as a graph: from each to the one that most often has the next line of an order, among all and among those of its nation.
FOLLOWED = """steps AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS dst FROM {lineitem}),
times AS (SELECT src, dst, a.s_nationkey = b.s_nationkey AS home, count(*) AS n FROM steps JOIN {supplier} a ON src = a.s_suppkey JOIN {supplier} b ON dst = b.s_suppkey WHERE src <> dst GROUP BY src, dst, a.s_nationkey = b.s_nationkey),
best AS (SELECT src, dst, home, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r, row_number() OVER (PARTITION BY src, home ORDER BY n DESC, dst) AS r_home FROM times),
e AS (SELECT src, dst FROM best WHERE r = 1 OR (home AND r_home = 1))"""
DUCK_FOLLOWED = FOLLOWED.format(lineitem="lineitem", supplier="supplier")


@query("cte08_supplier_cycles", f"WITH RECURSIVE {DUCK_FOLLOWED}, w AS (SELECT src AS a, dst AS b FROM e UNION SELECT w.a, e.dst FROM w JOIN e ON e.src = w.b) SELECT x.a AS node, min(x.b) AS component FROM w x JOIN w y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def _(t):
    return cyclic_components(t.sql(f"WITH {FOLLOWED} SELECT src, dst FROM e"))


#: Parts as a bill of material: a part holds the two smaller parts that are most often in one order with it, one more of each than there are such orders.
MATERIAL = """once AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, p_size AS size FROM {lineitem} JOIN {part} ON l_partkey = p_partkey),
together AS (SELECT a.p AS whole, b.p AS piece, count(*) AS times FROM once a JOIN once b ON a.o = b.o AND a.size > b.size GROUP BY a.p, b.p),
material AS (SELECT whole, piece, times + 1 AS n, row_number() OVER (PARTITION BY whole ORDER BY times DESC, piece) AS r FROM together)"""
DUCK_MATERIAL = MATERIAL.format(lineitem="lineitem", part="part")


@query("cte06_part_explosion", f"WITH RECURSIVE {DUCK_MATERIAL}, e AS (SELECT whole, piece, n FROM material WHERE r <= 2), x AS (SELECT whole AS root, piece, CAST(n AS HUGEINT) AS n FROM e WHERE whole NOT IN (SELECT piece FROM e) UNION ALL SELECT x.root, e.piece, x.n * e.n FROM x JOIN e ON e.whole = x.piece) SELECT root, piece, CAST(sum(n) AS BIGINT) AS needed FROM x GROUP BY root, piece")
def _(t):
    return explosion(t.sql(f"WITH {MATERIAL} SELECT whole, piece, n FROM material WHERE r <= 2")).withColumn("needed", F.col("needed").cast("long"))


@query("cte04_part_dependencies", f"WITH RECURSIVE {DUCK_MATERIAL}, n AS (SELECT p_partkey AS id, piece AS next, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part LEFT JOIN material ON whole = p_partkey AND r = 1), x AS (SELECT id, id AS last, next, 1 AS steps, cents, cents AS dearest FROM n UNION ALL SELECT x.id, n.id, n.next, x.steps + 1, x.cents + n.cents, greatest(x.dearest, n.cents) FROM x JOIN n ON n.id = x.next) SELECT id, last, CAST(steps AS BIGINT) AS steps, CAST(cents AS BIGINT) AS cents, dearest FROM x WHERE next IS NULL")
def _(t):
    # each part depends on the piece it holds most of
    steps = t.sql(f"WITH {MATERIAL} SELECT p_partkey AS id, piece AS next, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM {{part}} LEFT JOIN material ON whole = p_partkey AND r = 1")
    return chains(steps.withColumn("dearest", F.col("cents")), {"cents": "sum", "dearest": "max"})


#: Orders as chains: an order hands on to its customer's next one if that comes within half a year.
HANDED = "SELECT id, CASE WHEN gap <= 180 THEN after END AS next, CASE WHEN gap <= 180 THEN gap ELSE 0 END AS days FROM (SELECT o_orderkey AS id, lead(o_orderkey) OVER w AS after, {gap} AS gap FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) o"


@query("cte05_order_chains", f"WITH RECURSIVE n AS ({HANDED.format(orders='orders', gap='CAST(lead(o_orderdate) OVER w AS DATE) - CAST(o_orderdate AS DATE)')}), x AS (SELECT id, id AS last, next, 1 AS steps, days FROM n UNION ALL SELECT x.id, n.id, n.next, x.steps + 1, x.days + n.days FROM x JOIN n ON n.id = x.next) SELECT id, last, CAST(steps AS BIGINT) AS steps, CAST(days AS BIGINT) AS days FROM x WHERE next IS NULL")
def _(t):
    gap = "datediff(CAST(lead(o_orderdate) OVER w AS DATE), CAST(o_orderdate AS DATE))"
    steps = t.sql(HANDED.replace("{gap}", gap)).withColumn("days", F.col("days").cast("long"))
    return chains(steps, {"days": "sum"})
