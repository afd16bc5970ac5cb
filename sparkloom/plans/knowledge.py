"""Queries of the engine's own operators: profiling, relations, checks, routing, admission, audit, workload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotate, checks, corpus, evidence, guard, profile, refine, relations, semantics, workload
from ..sources.tables import FOREIGN_KEYS, PRIMARY_KEYS, Tables, register
from .registry import query

RELATIONAL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: Columns of the relational tables with their kinds, in order.
COLUMNS = {
    "region": "r_regionkey:numeric r_name:text",
    "nation": "n_nationkey:numeric n_name:text n_regionkey:numeric",
    "customer": "c_custkey:numeric c_name:text c_nationkey:numeric c_acctbal:numeric c_mktsegment:text",
    "supplier": "s_suppkey:numeric s_name:text s_nationkey:numeric s_acctbal:numeric",
    "part": "p_partkey:numeric p_name:text p_brand:text p_type:text p_size:numeric p_retailprice:numeric",
    "orders": "o_orderkey:numeric o_custkey:numeric o_orderstatus:text o_totalprice:numeric o_orderdate:date o_orderpriority:text",
    "lineitem": "l_orderkey:numeric l_partkey:numeric l_suppkey:numeric l_linenumber:numeric l_quantity:numeric l_extendedprice:numeric l_discount:numeric l_tax:numeric l_returnflag:text l_linestatus:text l_shipdate:date",
}
FIELDS = [(t, i, *x.split(":")) for t, text in COLUMNS.items() for i, x in enumerate(text.split())]


def k1(t: Tables, names: tuple[str, ...] = RELATIONAL) -> DataFrame:
    return profile.profile_all({n: getattr(t, n) for n in names})


def schema(t: Tables) -> DataFrame:
    """What K1 knows without reading a table."""
    return profile.schema_of({n: getattr(t, n) for n in RELATIONAL})


#: K1 in DuckDB: one row for each column, counted directly.
K1_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {i} AS ordinal, '{c}' AS column_name, '{k}' AS kind, {c in PRIMARY_KEYS.get(t, [])} AS primary_key, {(t, c) in FOREIGN_KEYS} AS foreign_key, count(*) AS row_count, count(DISTINCT {c}) AS n_distinct FROM {t}" for t, i, c, k in FIELDS)
LEVEL_SQL = f"SELECT *, CASE WHEN row_count = 0 OR n_distinct = 0 THEN 'medium' WHEN n_distinct / row_count < 0.1 THEN 'low' WHEN n_distinct / row_count > 0.7 THEN 'high' ELSE 'medium' END AS entropy_level FROM ({K1_SQL})"
K3_SQL = f"SELECT *, CASE WHEN primary_key OR foreign_key OR regexp_matches(column_name, '(key|_id|^id)$') THEN 'identifier' WHEN kind = 'date' THEN 'datetime' WHEN n_distinct = 2 AND regexp_matches(column_name, 'flag|status|is_|has_|yn$') THEN 'boolean' WHEN kind = 'numeric' THEN 'measure' WHEN entropy_level = 'low' THEN 'dimension' ELSE 'text' END AS category FROM ({LEVEL_SQL})"


@query("prf01_row_count", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in RELATIONAL))
def _(t):
    return reduce(DataFrame.unionByName, (getattr(t, n).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in RELATIONAL))


@query("prf02_distinct_count", f"SELECT table_name, column_name, n_distinct FROM ({K1_SQL})")
def _(t):
    return k1(t).select("table_name", "column_name", "n_distinct")


@query("prf03_entropy_level", f"SELECT table_name, column_name, row_count, n_distinct, entropy_level FROM ({LEVEL_SQL})")
def _(t):
    return k1(t).select("table_name", "column_name", "row_count", "n_distinct", "entropy_level")


#: All columns of text, of all tables.
SAMPLED = tuple((t, c) for t, _, c, k in FIELDS if k == "text")


@query("prf04_distinct_sample", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, array_to_string(list(v ORDER BY v), '|') AS samples FROM (SELECT DISTINCT substr({c}, 1, 40) AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)" for t, c in SAMPLED))
def _(t):
    return k1(t).where("kind = 'text'").select("table_name", "column_name", F.array_join("sample_values", "|").alias("samples"))


@query("prf05_category_distribution", f"WITH c AS (SELECT table_name, category, count(*) AS n, list(column_name ORDER BY column_name)[1:3] AS e FROM ({K3_SQL}) GROUP BY table_name, category) SELECT table_name, category, n, round(n / sum(n) OVER (PARTITION BY table_name) * 100, 1) AS percentage, array_to_string(e, ',') AS examples FROM c")
def _(t):
    return semantics.category_distribution(semantics.classify(k1(t))).withColumn("examples", F.array_join("examples", ","))


COUNTS = "count(*) FILTER (WHERE entropy_level = 'low') AS low, count(*) FILTER (WHERE entropy_level = 'medium') AS medium, count(*) FILTER (WHERE entropy_level = 'high') AS high, count(*) AS n"
ENTROPY_SQL = f"SELECT table_name, low, medium, high, round(low / n * 100, 1) AS low_pct, round(medium / n * 100, 1) AS medium_pct, round(high / n * 100, 1) AS high_pct FROM (SELECT table_name, {COUNTS} FROM ({LEVEL_SQL}) GROUP BY table_name)"


@query("prf06_entropy_distribution", ENTROPY_SQL)
def _(t):
    return semantics.entropy_distribution(k1(t))


@query("prf07_entropy_guidance", f"SELECT table_name, CASE WHEN low_pct > 60 THEN 'mostly_categorical' WHEN high_pct > 40 THEN 'mostly_unique' WHEN medium_pct > 50 THEN 'mostly_varied' ELSE 'mixed' END AS guidance FROM ({ENTROPY_SQL})")
def _(t):
    return semantics.guidance(semantics.entropy_distribution(k1(t)))


PATTERN_SQL = f"SELECT table_name, CASE WHEN d >= 3 AND i = 0 THEN 'dictionary' WHEN i >= 2 THEN 'master' WHEN m > 0 AND d >= 3 THEN 'fact' WHEN d >= 3 THEN 'dimension' ELSE 'generic' END AS pattern FROM (SELECT table_name, count(*) FILTER (WHERE category = 'identifier') AS i, count(*) FILTER (WHERE category = 'measure') AS m, count(*) FILTER (WHERE category = 'dimension') AS d FROM ({K3_SQL}) GROUP BY table_name)"


@query("prf08_business_pattern", PATTERN_SQL)
def _(t):
    return semantics.patterns(semantics.classify(k1(t))).select("table_name", "pattern")


@query("prf09_business_type", f"SELECT table_name, CASE pattern WHEN 'dictionary' THEN 'config' WHEN 'master' THEN 'entity' WHEN 'dimension' THEN 'dimension' ELSE 'data_table' END AS business_type FROM ({PATTERN_SQL})")
def _(t):
    return semantics.patterns(semantics.classify(k1(t))).select("table_name", "business_type")


@query("prf10_representative_samples", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, array_to_string(list(CASE WHEN length(v) > 20 THEN substr(v, 1, 17) || '...' ELSE v END ORDER BY v), ', ') AS samples FROM (SELECT DISTINCT substr({c}, 1, 40) AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)" for t, c in SAMPLED))
def _(t):
    return semantics.representative_samples(k1(t).where("kind = 'text'"))


@query("prf11_key_columns", f"SELECT table_name, CAST(sum(primary_key::INT) AS BIGINT) AS pk_count, CAST(sum(foreign_key::INT) AS BIGINT) AS fk_count, coalesce(string_agg(column_name, ',' ORDER BY ordinal) FILTER (WHERE primary_key), '') AS key_columns FROM ({K1_SQL}) GROUP BY table_name")
def _(t):
    return semantics.key_columns(schema(t)).withColumn("key_columns", F.array_join("key_columns", ","))


def _ddl_sql(table: str) -> str:
    keys = ", ".join(f"'{c}'" for c in PRIMARY_KEYS.get(table, [])) or "''"
    kind = "CASE column_type WHEN 'INTEGER' THEN 'INT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'TIMESTAMP' THEN 'TIMESTAMP_NTZ' ELSE column_type END"
    return f"SELECT '{table}' AS table_name, 'CREATE TABLE {table} (' || chr(10) || string_agg('  ' || column_name || ' ' || {kind} || CASE WHEN column_name IN ({keys}) THEN ' PRIMARY KEY' ELSE '' END, ',' || chr(10) ORDER BY i) || chr(10) || ');' AS ddl FROM (SELECT *, row_number() OVER () AS i FROM (DESCRIBE {table}))"


DDL_SQL = " UNION ALL ".join(map(_ddl_sql, RELATIONAL))


@query("prf12_ddl", DDL_SQL)
def _(t):
    return profile.ddl(schema(t))


#: A table beyond the limit of 60,000 characters: 5000 columns of which every thousandth is a key.
WIDE = 5000


@query("prf13_ddl_shortened", f"SELECT table_name, ddl FROM ({DDL_SQL}) UNION ALL SELECT 'wide', 'CREATE TABLE wide (' || chr(10) || string_agg('  c' || i || ' BIGINT PRIMARY KEY' || CASE WHEN i < {WIDE - 1000} THEN ',' ELSE '' END, chr(10) ORDER BY i) FROM range(0, {WIDE}, 1000) r(i)")
def _(t):
    wide = t.spark.range(WIDE).select(F.lit("wide").alias("table_name"), F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("column_name"), F.lit("bigint").alias("data_type"), (F.col("id") % 1000 == 0).alias("primary_key"))
    columns = schema(t).select(wide.columns).unionByName(wide)
    text = profile.ddl(columns).select("table_name", profile.shortened(F.col("ddl")).alias("ddl"))
    # the last key's line ends in a comma unless it is the table's last column
    return text.withColumn("ddl", F.when(F.col("table_name") == "wide", F.regexp_replace("ddl", ",$", "")).otherwise(F.col("ddl")))


@query("prf14_domain_confidence", "SELECT 0.72::DOUBLE AS three_of_five, 1.0::DOUBLE AS all_of_five")
def _(t):
    x, none = F.lit("x"), F.lit(None).cast("string")
    return t.spark.range(1).select(F.round(semantics.domain_confidence(x, x, x, none, F.lit("")), 6).alias("three_of_five"), F.round(semantics.domain_confidence(x, x, x, x, x), 6).alias("all_of_five"))


@query("prf15_importance", f"SELECT table_name, column_name, CASE WHEN primary_key OR foreign_key THEN 'high' WHEN category IN ('measure', 'dimension') THEN 'medium' ELSE 'low' END AS importance, category IN ('measure', 'dimension') AS measure_or_dimension FROM ({K3_SQL})")
def _(t):
    return semantics.importance(k1(t))


@query("prf16_layer_summary", f"SELECT 'columns' AS layer, {len(FIELDS)}::BIGINT AS n UNION ALL SELECT 'fields', {len(FIELDS)} UNION ALL SELECT 'relations', 7")
def _(t):
    k = k1(t)
    return semantics.layer_summary(columns=k, fields=semantics.classify(k), relations=relations.declared(k))


@query("llm03_field_categories", f"SELECT table_name, column_name, category FROM ({K3_SQL})")
def _(t):
    return semantics.classify(k1(t)).select("table_name", "column_name", "category")


NAMED = [("user_id", "sale"), ("customerID", "sale"), ("paid", "sale"), ("status_id", "sale"), ("users_key", "sale")]


def _named(t: Tables) -> DataFrame:
    rows = [("sale", c, False) for c, _ in NAMED] + [("users", "id", True), ("customer", "id", True), ("status", "code", True)]
    return t.spark.createDataFrame([(a, b, p, False) for a, b, p in rows], "table_name string, column_name string, primary_key boolean, foreign_key boolean")


@query("rel01_name_heuristic", "SELECT * FROM (VALUES ('sale', 'user_id', 'users', 'id'), ('sale', 'customerID', 'customer', 'id'), ('sale', 'status_id', 'status', 'code')) v(source_table, source_column, target_table, target_column)")
def _(t):
    return relations.by_name(_named(t)).select("source_table", "source_column", "target_table", "target_column")


DECLARED = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for (a, b), (c, d) in FOREIGN_KEYS.items() if a in RELATIONAL)


@query("rel02_declared", f"SELECT * FROM (VALUES {DECLARED}) v(source_table, source_column, target_table, target_column)")
def _(t):
    return relations.declared(schema(t)).select("source_table", "source_column", "target_table", "target_column")


@query("rel03_merged", f"SELECT *, 0.9::DOUBLE AS confidence FROM (VALUES {DECLARED}) v(source_table, source_column, target_table, target_column)")
def _(t):
    k = schema(t)
    return relations.merged(relations.declared(k), relations.by_name(k)).select("source_table", "source_column", "target_table", "target_column", "confidence")


@query("rel04_entities", "SELECT * FROM (VALUES ('orders', 'customer', 'many_to_one'), ('nation', 'region', 'many_to_one')) v(source_table, target_table, relationship_type)")
def _(t):
    model = t.spark.createDataFrame([("Order", "Customers", "N:1"), ("Nation", "region", "belongs to"), ("Order", "Nowhere", "1:1")], "source_entity string, target_entity string, kind string")
    names = t.spark.createDataFrame([(n,) for n in RELATIONAL], "table_name string")
    return relations.from_entities(model, names).select("source_table", "target_table", "relationship_type")


@query("rel05_types", "SELECT * FROM (VALUES ('m:n', 'many_to_many'), ('1:1', 'one_to_one'), ('one-to-many', 'one_to_many'), ('parent', 'many_to_one')) v(stated, kind)")
def _(t):
    return t.spark.createDataFrame([("m:n",), ("1:1",), ("one-to-many",), ("parent",)], "stated string").withColumn("kind", relations.relation_type(F.col("stated")))


@query("rel06_model_validation", "SELECT 'Order' AS source_entity, 'Customer' AS target_entity")
def _(t):
    entities = t.spark.createDataFrame([("Order", "orders", "o_orderkey"), ("Customer", "customer", "c_custkey"), ("Ghost", "orders", "nope")], "entity string, table_name string, column_name string")
    model = t.spark.createDataFrame([("Order", "Customer"), ("Order", "Ghost")], "source_entity string, target_entity string")
    return relations.valid_model(entities, model, schema(t))[1].select("source_entity", "target_entity")


@query("rel07_inclusion", "SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders) o ANTI JOIN customer c ON o.o_custkey = c.c_custkey) AS orphans, (SELECT count(c_custkey) = count(DISTINCT c_custkey) FROM customer) AS \"unique\"")
def _(t):
    return relations.included(t.orders, "o_custkey", t.customer, "c_custkey")


@query("rel08_foreign_keys", "SELECT source_table, count(*) AS n FROM (VALUES " + DECLARED + ") v(source_table, b, c, d) GROUP BY source_table")
def _(t):
    return relations.foreign_keys(relations.declared(schema(t))).groupBy("source_table").agg(F.count("*").alias("n"))


@query("lkp01_table_columns", f"SELECT table_name, column_name, category, 'rule' AS source, primary_key FROM ({K3_SQL})")
def _(t):
    k = k1(t)
    return annotate.column_descriptions(k, semantics.classify(k)).select("table_name", "column_name", "category", "source", "primary_key")


LOOKED_UP = "(VALUES ('a', 'orders', 'o_custkey'), ('b', 'part', 'p_brand'), ('c', 'part', 'no_such'), ('d', 'nowhere', 'x')) w(question_id, table_name, column_name)"


def _wanted(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("a", "orders", "o_custkey"), ("b", "part", "p_brand"), ("c", "part", "no_such"), ("d", "nowhere", "x")], "question_id string, table_name string, column_name string")


@query("lkp02_one_column", f"SELECT question_id, table_name, column_name, category FROM {LOOKED_UP} LEFT JOIN ({K3_SQL}) k USING (table_name, column_name)")
def _(t):
    return _wanted(t).join(semantics.classify(k1(t)), ["table_name", "column_name"], "left").select("question_id", "table_name", "column_name", "category")


@query("lkp04_table_semantics", f"SELECT table_name, pattern FROM ({PATTERN_SQL}) WHERE table_name IN ('part', 'orders')")
def _(t):
    return semantics.patterns(semantics.classify(k1(t))).where("table_name IN ('part', 'orders')").select("table_name", "pattern")


SCHEMA_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name" for t, _, c, _ in FIELDS)


@query("lkp05_schema_lookups", f"SELECT question_id, table_name IN (SELECT table_name FROM ({SCHEMA_SQL})) AS table_known, (table_name, column_name) IN (SELECT (table_name, column_name) FROM ({SCHEMA_SQL})) AS column_known, {len(RELATIONAL)}::BIGINT AS tables FROM {LOOKED_UP}")
def _(t):
    known = schema(t).select("table_name", "column_name")
    tables = known.select("table_name").distinct()
    found = _wanted(t).join(known.withColumn("c", F.lit(True)), ["table_name", "column_name"], "left").join(tables.withColumn("t", F.lit(True)), "table_name", "left")
    return found.crossJoin(F.broadcast(tables.agg(F.count("*").alias("tables")))).select("question_id", F.coalesce("t", F.lit(False)).alias("table_known"), F.coalesce("c", F.lit(False)).alias("column_known"), "tables")


@query("lkp03_category_map", f"SELECT table_name || '.' || column_name AS k, category AS v FROM ({K3_SQL})")
def _(t):
    k3 = semantics.classify(k1(t)).groupBy("table_name", "column_name").agg(F.last("category").alias("category"))
    whole = k3.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(".", "table_name", "column_name"), "category"))).alias("m"))
    return whole.select(F.explode("m").alias("k", "v"))


@query("lkp06_relations_of_table", "SELECT * FROM (VALUES " + DECLARED + ") v(source_table, source_column, target_table, target_column) WHERE source_table = 'orders' OR target_table = 'orders'")
def _(t):
    return relations.involving(relations.declared(schema(t)), "orders").select("source_table", "source_column", "target_table", "target_column")


@query("lkp09_json_names", "SELECT * FROM (VALUES ('orders'), ('customer'), ('part')) v(name)")
def _(t):
    text = t.spark.createDataFrame([('["orders", {"name": "customer", "type": "x"}, {"name": "part"}]',)], "j string")
    return text.select(F.explode(annotate.strings(F.col("j"))).alias("name"))


@query("lkp07_no_evidence", "SELECT 'd' AS question_id")
def _(t):
    k3 = semantics.classify(k1(t))
    questions = _errors(t).where("question_id IN ('c', 'd')").select("question_id")
    found = evidence.layers_for(_errors(t)).where("layer = 'K3'").join(k3, "table_name").select("question_id")
    return evidence.is_empty(found, questions)


@query("lkp08_is_evaluation", "SELECT * FROM (VALUES ('spider', 'concert_singer', true), ('spider', 'academic', false), ('bird', 'superhero', true)) v(benchmark, database, kept_for_evaluation)")
def _(t):
    rows = t.spark.createDataFrame([("spider", "academic"), ("spider", "concert_singer"), ("bird", "superhero")], "benchmark string, database string")
    free = workload.train_databases(rows).withColumn("free", F.lit(True))
    return rows.join(free, ["benchmark", "database"], "left").select("benchmark", "database", F.col("free").isNull().alias("kept_for_evaluation"))


@query("lkp10_relations_by_reason", "SELECT * FROM (VALUES ('conceptual', 'nation', 'region'), ('conceptual', 'orders', 'customer')) v(part, source_table, target_table) UNION ALL SELECT 'logical', a, c FROM (VALUES " + DECLARED + ") v(a, b, c, d)")
def _(t):
    model = t.spark.createDataFrame([("Order", "Customers", "N:1"), ("Nation", "region", "belongs to")], "source_entity string, target_entity string, kind string")
    names = t.spark.createDataFrame([(n,) for n in RELATIONAL], "table_name string")
    both = relations.declared(schema(t)).unionByName(relations.from_entities(model, names))
    return relations.split(both).select("part", "source_table", "target_table")


@query("llm06_conceptual_model", "SELECT upper(source_table[1]) || source_table[2:] AS source_entity, upper(target_table[1]) || target_table[2:] AS target_entity, 'N:1' AS kind FROM (VALUES " + DECLARED + ") v(source_table, b, target_table, d)")
def _(t):
    return relations.proposed_model(schema(t))[1].select("source_entity", "target_entity", "kind")


@query("scn04_complexity_shares", "SELECT s AS main_scenario, l AS complexity_level, x::DOUBLE AS share FROM (VALUES " + ", ".join(f"('{s}')" for s, *_ in workload.SCENARIOS) + ") v(s), (VALUES " + ", ".join(f"({i + 1}, {x})" for i, x in enumerate(workload.LEVEL_SHARES)) + ") w(l, x)")
def _(t):
    return workload.complexity_shares(t.spark)


@query("trp01_triples", "SELECT * FROM (VALUES ('a', 'knows', 'b'), ('a', 'knows', 'c')) v(subject, predicate, object)")
def _(t):
    rows = t.spark.createDataFrame([("a", "knows", "b"), ("a", "knows", "c"), ("a", "likes", "b"), ("b", "knows", "c")], "subject string, predicate string, object string")
    return corpus.triples(rows, "knows", "a")


#: Statements with one fault each, or none.
STATEMENTS = {
    "good": "SELECT o.o_custkey, SUM(o.o_totalprice) AS s FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o.o_custkey",
    "avg_of_key": "SELECT AVG(o_custkey) AS a FROM orders",
    "avg_in_cte": "WITH x AS (SELECT o_custkey AS k FROM orders) SELECT AVG(b.k) AS a FROM x a JOIN x b ON a.k = b.k",
    "wrong_key": "SELECT c_name FROM orders JOIN customer ON o_orderkey = c_custkey",
    "unrelated": "SELECT p_name FROM part JOIN customer ON p_partkey = c_custkey",
    "no_column": "SELECT o_nothing FROM orders",
    "no_table": "SELECT 1 AS one FROM nowhere",
    "syntax": "SELEC o_orderkey FROM orders",
    "types": "SELECT CAST('x' AS INT) AS i FROM region",
    "writes": "DROP TABLE orders",
    "empty": " ; ",
}


def _facts(t: Tables) -> checks.FactTables:
    register(t.spark, t.folder, RELATIONAL)
    return checks.FactTables(t.spark, STATEMENTS)


@query("ast03_aggregates", "SELECT * FROM (VALUES ('good', 'SUM', 'orders', 'o_totalprice'), ('avg_of_key', 'AVG', 'orders', 'o_custkey'), ('avg_in_cte', 'AVG', 'orders', 'o_custkey')) v(question_id, func, table_name, column_name)")
def _(t):
    return _facts(t).aggregates.select("question_id", "func", "table_name", "column_name")


@query("ast04_joins", "SELECT * FROM (VALUES ('good', 'orders', 'o_custkey', 'customer', 'c_custkey'), ('wrong_key', 'orders', 'o_orderkey', 'customer', 'c_custkey'), ('unrelated', 'part', 'p_partkey', 'customer', 'c_custkey'), ('avg_in_cte', 'orders', 'o_custkey', 'orders', 'o_custkey')) v(question_id, left_table, left_column, right_table, right_column)")
def _(t):
    return _facts(t).joins


@query("ast05_columns", "SELECT * FROM (VALUES ('good', 'orders', 'o_custkey'), ('good', 'orders', 'o_totalprice'), ('good', 'customer', 'c_custkey'), ('avg_of_key', 'orders', 'o_custkey'), ('avg_in_cte', 'orders', 'o_custkey'), ('wrong_key', 'customer', 'c_name'), ('wrong_key', 'orders', 'o_orderkey'), ('wrong_key', 'customer', 'c_custkey'), ('unrelated', 'part', 'p_name'), ('unrelated', 'part', 'p_partkey'), ('unrelated', 'customer', 'c_custkey')) v(question_id, table_name, column_name)")
def _(t):
    return _facts(t).columns


@query("ast06_tables", "SELECT * FROM (VALUES ('good', 'orders'), ('good', 'customer'), ('avg_of_key', 'orders'), ('avg_in_cte', 'orders'), ('wrong_key', 'orders'), ('wrong_key', 'customer'), ('unrelated', 'part'), ('unrelated', 'customer'), ('types', 'region')) v(question_id, table_name)")
def _(t):
    return _facts(t).tables


@query("exe05_error_classes", "SELECT * FROM (VALUES ('good', true, NULL), ('avg_of_key', true, NULL), ('avg_in_cte', true, NULL), ('wrong_key', true, NULL), ('unrelated', true, NULL), ('no_column', false, 'column_not_found'), ('no_table', false, 'table_not_found'), ('syntax', false, 'syntax_error'), ('types', false, 'type_error'), ('writes', false, 'execution_failed'), ('empty', false, 'syntax_error')) v(question_id, success, error_type)")
def _(t):
    register(t.spark, t.folder, RELATIONAL)
    out = {n: guard.execute(t.spark, s) for n, s in STATEMENTS.items()}
    return t.spark.createDataFrame([(n, o.success, o.error_type) for n, o in out.items()], "question_id string, success boolean, error_type string")


@query("exe01_outcomes", "SELECT * FROM (VALUES ('good', true, 100::BIGINT, true), ('types', false, 0, false), ('syntax', false, 0, false)) v(question_id, success, row_count, truncated)")
def _(t):
    register(t.spark, t.folder, RELATIONAL)
    out = {n: guard.execute(t.spark, STATEMENTS[n]) for n in ("good", "types", "syntax")}
    return t.spark.createDataFrame([(n, o.success, o.row_count or 0, bool(o.truncated)) for n, o in out.items()], "question_id string, success boolean, row_count bigint, truncated boolean")


@query("exe07_cleaned", "SELECT * FROM (VALUES ('SELECT 1'), ('')) v(statement)")
def _(t):
    return t.spark.createDataFrame([(guard.cleaned(x),) for x in ("  SELECT 1 ; ", " ; ")], "statement string")


@query("exe02_limited", "SELECT 100::BIGINT AS row_count, true AS truncated")
def _(t):
    register(t.spark, t.folder, ("orders",))
    o = guard.execute(t.spark, "SELECT o_orderkey AS no_limit FROM orders;")
    return t.spark.createDataFrame([(o.row_count, o.truncated)], "row_count bigint, truncated boolean")


@query("chk02_columns", "SELECT 'q2' AS question_id, 'column_not_found' AS type, 'orders.o_gone' AS detail")
def _(t):
    refs = t.spark.createDataFrame([("q1", "orders", "o_custkey"), ("q2", "orders", "o_gone"), ("q3", "orders", "c_name")], "question_id string, table_name string, column_name string")
    return checks.check_columns(refs, schema(t)).select("question_id", "type", "detail")


@query("chk03_joins", "SELECT 'wrong_key' AS question_id, 'join_invalid' AS type, 'orders.o_orderkey = customer.c_custkey' AS detail")
def _(t):
    return checks.check_joins(_facts(t).joins, relations.declared(schema(t))).select("question_id", "type", "detail")


@query("chk04_aggregates", "SELECT * FROM (VALUES ('avg_of_key', 'aggregation_type_mismatch', 'K3:orders.o_custkey'), ('avg_in_cte', 'aggregation_type_mismatch', 'K3:orders.o_custkey')) v(question_id, type, evidence_ref)")
def _(t):
    facts = _facts(t)
    # categories are asked for of the columns that statements aggregate, and only those are profiled
    used = {(r[0], r[1]) for r in facts.aggregates.select("table_name", "column_name").distinct().collect()}
    k3 = semantics.classify(profile.profile_all({n: getattr(t, n) for n in RELATIONAL}, columns=used))
    return checks.check_aggregates(facts.aggregates, k3).select("question_id", "type", "evidence_ref")


@query("chk06_review", "SELECT * FROM (VALUES ('q1', 'II-1', 's'), ('q1', NULL, 'q')) v(question_id, semantic_class, artifact)")
def _(t):
    issues = t.spark.createDataFrame([("q1", "II-1", "zzz", None, None, None, "role", None), ("q1", "IX", "q", None, None, None, "other", None), ("q1", "I-1", "s", None, None, None, " ", None), ("q9", "I-1", "s", None, None, None, "x", None)], "question_id string, class string, artifact string, clause string, table_name string, column_name string, detail string, condition string")
    return checks.review(t.spark.createDataFrame([("q1",)], "question_id string"), issues).select("question_id", "semantic_class", "artifact")


@query("chk09_references", "SELECT * FROM (VALUES ('q2'), ('q3')) v(question_id)")
def _(t):
    refs = t.spark.createDataFrame([("q1", "orders", None), ("q1", "orders", "o_custkey"), ("q2", "nowhere", None), ("q3", "orders", "c_name")], "question_id string, table_name string, column_name string")
    return checks.unknown_references(refs, schema(t))


@query("chk08_digest", "SELECT 'avg_of_key' AS question_id, '- orders.o_custkey [identifier]' AS first_line")
def _(t):
    k = k1(t)
    k3 = semantics.classify(k)
    found = checks.digest(_facts(t), k, k3, annotate.column_descriptions(k, k3), relations.declared(k))
    return found.where("question_id = 'avg_of_key'").select("question_id", F.regexp_extract("digest", r"^(- orders\.o_custkey \[\w+\])", 1).alias("first_line"))


ERRORS = [("a", "column_not_found", None), ("b", "join_invalid", None), ("c", "aggregation_type_mismatch", None), ("d", "semantic_inconsistency", "I-2"), ("e", "semantic_inconsistency", "II-1"), ("f", "semantic_inconsistency", "II-2"), ("g", "semantic_inconsistency", "III-1")]


def _errors(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(q, k, None, "orders", "o_custkey", None, None, c, "s", None) for q, k, c in ERRORS], checks.ERROR)


@query("chk08_digest_layers", "SELECT 'types' AS question_id, 'Domain: Records of customer, lineitem, nation, orders, part, region, supplier' AS first_line, 5::BIGINT AS lines")
def _(t):
    # a statement without columns: the domain, its table's meaning, all of the table's columns, and its relation
    k = k1(t)
    k3 = semantics.classify(k)
    k5 = annotate.table_descriptions(semantics.patterns(k3), semantics.key_columns(k))
    found = checks.digest(_facts(t), k, k3, annotate.column_descriptions(k, k3), relations.declared(k), annotate.domain(k, "x"), k5).where("question_id = 'types'")
    lines = F.split("digest", "\n")
    return found.select("question_id", F.get(lines, F.lit(0)).alias("first_line"), F.size(lines).cast("long").alias("lines"))


@query("chk10_error_defaults", "SELECT * FROM (VALUES ('a', 'structural', 'program'), ('b', 'structural', 'program'), ('c', 'structural', 'program'), ('d', 'semantic', 'llm'), ('e', 'semantic', 'llm'), ('f', 'semantic', 'llm'), ('g', 'semantic', 'llm')) v(question_id, category, detector)")
def _(t):
    return checks.classified(_errors(t)).select("question_id", "category", "detector")


@query("evd01_routing", "SELECT * FROM (VALUES ('a', 'K4'), ('b', 'K6'), ('c', 'K3'), ('e', 'K3'), ('e', 'K4'), ('f', 'K6'), ('g', 'K2'), ('g', 'K5'), ('g', 'K6')) v(question_id, layer)")
def _(t):
    return evidence.layers_for(_errors(t)).select("question_id", "layer")


@query("evd02_rendering", "SELECT 'b' AS question_id, '1. lineitem.l_orderkey -> orders.o_orderkey' || chr(10) || '2. orders.o_custkey -> customer.c_custkey' AS block")
def _(t):
    k = k1(t)
    k3 = semantics.classify(k)
    k5 = annotate.table_descriptions(semantics.patterns(k3), semantics.key_columns(k))
    found = evidence.retrieve(_errors(t), annotate.domain(k, "x"), k3, annotate.column_descriptions(k, k3), k5, relations.declared(k))
    return evidence.rendered(found.where("question_id = 'b'"))


@query("ref01_refinement", "SELECT * FROM (VALUES ('good', 'accepted', 1), ('avg_of_key', 'accepted', 2), ('wrong_key', 'accepted', 2), ('no_column', 'rejected', 3), ('writes', 'rejected', 3)) v(question_id, decision, iterations)")
def _(t):
    register(t.spark, t.folder, RELATIONAL)
    k = k1(t).cache()
    k3 = semantics.classify(k)
    k4 = annotate.column_descriptions(k, k3)
    k5 = annotate.table_descriptions(semantics.patterns(k3), semantics.key_columns(k))
    known = refine.Knowledge(k, annotate.domain(k, "x"), k3, k4, k5, relations.declared(k))
    samples = [refine.Sample(n, "?", STATEMENTS[n] if n != "no_column" else "SELECT zzzzzzzzzzzz FROM orders") for n in ("good", "avg_of_key", "wrong_key", "no_column", "writes")]
    refine.refine(t.spark, samples, known, annotate.RuleAnnotator([], []), max_iterations=2)
    return refine.traces(t.spark, samples).select("question_id", "decision", F.size("iterations").alias("iterations"))


@query("ref03_admission", "SELECT * FROM (VALUES ('a', 'rejected', 'final_sql_not_executable'), ('b', 'rejected', 'question_invalid_unrepairable'), ('c', 'unresolved', 'diagnosis_errors_remain_after_limit'), ('d', 'accepted', 'executable_and_no_detected_errors')) v(question_id, decision, decision_reason)")
def _(t):
    rows = t.spark.createDataFrame([("a", False, 1, 1), ("b", True, 1, 1), ("c", True, 0, 2), ("d", True, 0, 0)], "question_id string, executable boolean, question_errors int, other_errors int")
    return corpus.admit(rows).select("question_id", "decision", "decision_reason")


@query("aud01_audit", "SELECT * FROM (VALUES ('decision', 'accepted', 2::BIGINT, 66.7::DOUBLE), ('decision', 'rejected', 1, 33.3), ('corrected', 'samples', 1, NULL), ('error_type', 'join_invalid', 2, NULL), ('error_type', 'semantic_inconsistency', 1, NULL), ('category', 'structural', 2, NULL), ('category', 'semantic', 1, NULL), ('detector', 'program', 2, NULL), ('detector', 'llm', 1, NULL), ('semantic_class', 'II-2', 1, NULL)) v(measure, value, n, percentage)")
def _(t):
    j, s = ("join_invalid", "structural", "program", None, "x"), ("semantic_inconsistency", "semantic", "llm", "II-2", "y")
    rows = [("a", "s", "s", "accepted", "r", [(0, "verified", "s", "s", [])]), ("b", "s", "u", "accepted", "r", [(0, "corrected", "s", "u", [j, s]), (1, "verified", "u", "u", [])]), ("c", "s", "s", "rejected", "r", [(0, "max_iterations_reached", "s", "s", [j])])]
    return corpus.audit(t.spark.createDataFrame(rows, corpus.TRACE))


@query("scn01_grid", "SELECT s AS main_scenario, p AS sub_scenario, l AS complexity_level FROM (VALUES " + ", ".join(f"('{s}', '{p}')" for s, _, ps in workload.SCENARIOS for p, _ in ps) + ") v(s, p), (VALUES (1), (2), (3), (4)) w(l)")
def _(t):
    return workload.grid(t.spark).select("main_scenario", "sub_scenario", "complexity_level")


@query("scn02_use_case_weights", "SELECT s AS sub_scenario, l AS complexity_level, 1.0::DOUBLE AS total FROM (VALUES " + ", ".join(f"('{p}')" for p in workload.USE_CASES) + ") v(s), (VALUES (1), (2), (3), (4)) w(l)")
def _(t):
    return workload.use_cases(t.spark).groupBy("sub_scenario", "complexity_level").agg(F.round(F.sum("weight"), 6).alias("total"))


@query("scn03_tasks", "SELECT 100::BIGINT AS n, 36::BIGINT AS combinations")
def _(t):
    return workload.tasks(t.spark, 100).agg(F.count("*").alias("n"), F.count_distinct("main_scenario", "sub_scenario", "complexity_level").alias("combinations"))


@query("scn05_complexity_gate", "SELECT * FROM (VALUES ('good', 1, 2::BIGINT), ('good', 2, 0), ('avg_in_cte', 3, 1), ('avg_in_cte', 4, 0), ('avg_of_key', 4, 1)) v(question_id, level, problems)")
def _(t):
    facts = _facts(t).facts
    cases = [("good", 1), ("good", 2), ("avg_in_cte", 3), ("avg_in_cte", 4), ("avg_of_key", 4)]
    problems = [(q, lv, len([p for p in checks.level_problems(facts[q].shape, lv) if not p.startswith("group")])) for q, lv in cases]
    return t.spark.createDataFrame(problems, "question_id string, level int, problems bigint")


def _databases(t: Tables, n: int) -> DataFrame:
    return t.spark.range(n).select(F.col("id").cast("int").alias("position"), F.format_string("db%02d", "id").alias("database"))


@query("wrk01_even_split", "SELECT i::INT AS position, printf('db%02d', i) AS database, (20000 // 30 + CASE WHEN i < 20000 % 30 THEN 1 ELSE 0 END)::BIGINT AS quota FROM range(30) r(i)")
def _(t):
    return workload.even_split(_databases(t, 30), 20000)


@query("wrk02_shard", "SELECT i::INT AS position, printf('db%02d', i) AS database FROM range(30) r(i) WHERE i % 4 = 1")
def _(t):
    return workload.shard(_databases(t, 30), 1, 4)


@query("wrk03_resume", "SELECT * FROM (VALUES ('db00', 5::BIGINT, 3::BIGINT), ('db02', 5, 5)) v(database, quota, missing)")
def _(t):
    quotas = t.spark.createDataFrame([("db00", 5), ("db01", 2), ("db02", 5)], "database string, quota bigint")
    done = t.spark.createDataFrame([("db00",)] * 2 + [("db01",)] * 2, "database string")
    return workload.pending(quotas, done)


@query("wrk05_leakage_guard", "SELECT 'spider' AS benchmark, 'academic' AS database")
def _(t):
    rows = t.spark.createDataFrame([("spider", "academic"), ("spider", "concert_singer"), ("bird", "superhero")], "benchmark string, database string")
    return workload.train_databases(rows)
