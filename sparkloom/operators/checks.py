"""Checks of many queries at once: facts become rows, each check is a join with the knowledge base."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import guard, lineage

ERROR = "question_id string, type string, clause string, table_name string, column_name string, detail string, evidence_ref string, semantic_class string, artifact string, violated_condition string"
#: Error types of meaning; the others are of structure.
SEMANTIC_TYPES = ("column_semantic_mismatch", "semantic_inconsistency", "semantic_review_failed")
#: Classes of errors of meaning.
SEMANTIC_CLASSES = ("I-1", "I-2", "I-3", "I-4", "II-1", "II-2", "III-1")


def classified(errors: DataFrame) -> DataFrame:
    """errors with category and detector by their type."""
    category = F.when(F.col("type").isin(*SEMANTIC_TYPES), "semantic").otherwise("structural")
    detector = F.when(F.col("type") == "semantic_inconsistency", "llm").otherwise("program")
    return errors.withColumns({"category": category, "detector": detector})


class FactTables:
    """Facts of statements as DataFrames. One analysis of each statement; statements are analysed by a few threads."""

    def __init__(self, spark: SparkSession, statements: dict[str, str], threads: int = 4):
        def one(item: tuple[str, str]) -> tuple[str, lineage.Facts | None, str | None, str | None]:
            name, sql = item
            if not guard.cleaned(sql):
                return name, None, "syntax_error", "empty statement"
            try:
                return name, lineage.facts_of(guard.query(spark, sql)), None, None
            except guard.NotAQuery as e:
                return name, None, "execution_failed", str(e)
            except Exception as e:  # what Spark's parser and analyzer say of the statement is the result here
                return name, None, guard.error_type(e.getCondition() if hasattr(e, "getCondition") else None, str(e)), str(e).strip().split("\n")[0][:300]

        with ThreadPoolExecutor(threads) as pool:
            found = list(pool.map(one, statements.items()))
        self.facts = {n: f for n, f, _, _ in found if f}
        rows = lambda of: [(n, *x) for n, f, _, _ in found if f for x in sorted(of(f))]
        q = "question_id string, "
        self.columns = spark.createDataFrame(rows(lambda f: f.columns), q + "table_name string, column_name string")
        self.tables = spark.createDataFrame(rows(lambda f: {(t,) for t in f.tables}), q + "table_name string")
        self.joins = spark.createDataFrame(rows(lambda f: f.joins), q + "left_table string, left_column string, right_table string, right_column string")
        self.aggregates = spark.createDataFrame(rows(lambda f: f.aggregates), q + "func string, table_name string, column_name string, clause string")
        self.functions = spark.createDataFrame(rows(lambda f: {(x,) for x in f.functions}), q + "func string")
        self.failed = spark.createDataFrame([(n, t, None, None, None, d, None, None, "s", None) for n, _, t, d in found if t], ERROR)


def _error(rows: DataFrame, kind: str, **values) -> DataFrame:
    none = F.lit(None).cast("string")
    base = {"type": F.lit(kind), "clause": none, "table_name": none, "column_name": none, "detail": none, "evidence_ref": none, "semantic_class": none, "artifact": F.lit("s"), "violated_condition": none}
    return rows.select("question_id", *((values.get(c) if c in values else x).alias(c) for c, x in base.items()))


def check_columns(columns: DataFrame, k1: DataFrame) -> DataFrame:
    """column_not_found for references that K1 lacks in their table and in any other."""
    lost = columns.join(k1.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti").join(k1.select("column_name").distinct(), "column_name", "left_anti")
    return _error(lost, "column_not_found", table_name=F.col("table_name"), column_name=F.col("column_name"), detail=F.concat_ws(".", "table_name", "column_name"), evidence_ref=F.concat(F.lit("K1:"), "table_name"))


def check_joins(joins: DataFrame, k6: DataFrame) -> DataFrame:
    """join_invalid where K6 relates the two tables by keys, but not by these columns. A pair without a relation is let pass."""
    known = k6.where("source_column IS NOT NULL AND target_column IS NOT NULL AND relationship_type IN ('many_to_one', 'one_to_many', 'one_to_one')")
    keys = known.select(F.col("source_table").alias("left_table"), F.col("source_column").alias("left_column"), F.col("target_table").alias("right_table"), F.col("target_column").alias("right_column"))
    keys = keys.unionByName(keys.select(F.col("right_table").alias("left_table"), F.col("right_column").alias("left_column"), F.col("left_table").alias("right_table"), F.col("left_column").alias("right_column")))
    related = joins.join(keys.select("left_table", "right_table").distinct(), ["left_table", "right_table"], "left_semi")
    wrong = related.join(keys, ["left_table", "left_column", "right_table", "right_column"], "left_anti")
    text = F.format_string("%s.%s = %s.%s", "left_table", "left_column", "right_table", "right_column")
    return _error(wrong, "join_invalid", clause=F.lit("ON"), table_name=F.col("left_table"), column_name=F.col("left_column"), detail=text, evidence_ref=F.concat(F.lit("K6:"), "left_table", F.lit("-"), "right_table"))


def check_aggregates(aggregates: DataFrame, k3: DataFrame) -> DataFrame:
    """aggregation_type_mismatch for SUM and AVG of fields that are no measures; fields without a category are let pass."""
    bad = aggregates.where(F.col("func").isin("SUM", "AVG")).join(k3.select("table_name", "column_name", "category"), ["table_name", "column_name"]).where("category <> 'measure'")
    detail = F.format_string("%s(%s.%s) on %s", "func", "table_name", "column_name", "category")
    return _error(bad, "aggregation_type_mismatch", clause=F.col("clause"), table_name=F.col("table_name"), column_name=F.col("column_name"), detail=detail, evidence_ref=F.format_string("K3:%s.%s", "table_name", "column_name"))


def check_execution(spark: SparkSession, outcomes: dict[str, guard.Outcome]) -> DataFrame:
    """execution_failed, or the class of failure, for statements that didn't run; an empty result is no error."""
    rows = [(n, o.error_type or "execution_failed", None, None, None, o.error, None, None, "s", None) for n, o in outcomes.items() if not o.success]
    return spark.createDataFrame(rows, ERROR)


def review(questions: DataFrame, issues: DataFrame) -> DataFrame:
    """Errors from a reviewer's issues (question_id, class, artifact, clause, table_name, column_name, detail, condition): those without detail go, unknown classes become null, unknown artifacts s."""
    kept = issues.join(questions.select("question_id"), "question_id", "left_semi").where(F.length(F.trim("detail")) > 0)
    return _error(
        kept,
        "semantic_inconsistency",
        clause=F.col("clause"),
        table_name=F.col("table_name"),
        column_name=F.col("column_name"),
        detail=F.col("detail"),
        semantic_class=F.when(F.col("class").isin(*SEMANTIC_CLASSES), F.col("class")),
        artifact=F.when(F.col("artifact").isin("q", "s", "r"), F.col("artifact")).otherwise("s"),
        violated_condition=F.col("condition"),
    )


def review_failed(questions: DataFrame, reason: str) -> DataFrame:
    return _error(questions.select("question_id"), "semantic_review_failed", detail=F.lit(reason))


def unknown_references(references: DataFrame, k1: DataFrame) -> DataFrame:
    """question_ids whose generated references (question_id, table_name, column_name or null) name a table or column that K1 lacks."""
    tables = references.join(k1.select("table_name").distinct(), "table_name", "left_anti").select("question_id")
    columns = references.where("column_name IS NOT NULL").join(k1.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti").select("question_id")
    return tables.unionByName(columns).distinct()


def digest(facts: FactTables, k1: DataFrame, k3: DataFrame, k4: DataFrame, k6: DataFrame, k2: DataFrame | None = None, k5: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """(question_id, digest): what the knowledge base says of the columns and tables a statement touches.

    The domain (K2) comes first, then the tables' meaning (K5), their columns and
    relations. A statement that names no known column is told all columns of its
    tables; named (question_id, table_name) are the tables of statements that
    couldn't be analysed.
    """
    tables = facts.tables.select("question_id", "table_name")
    if named is not None:
        tables = tables.unionByName(named.select("question_id", "table_name")).distinct()
    columns = facts.columns.select("question_id", "table_name", "column_name")
    without = tables.join(columns.join(k1.select("table_name", "column_name"), ["table_name", "column_name"], "left_semi").select("question_id").distinct(), "question_id", "left_anti")
    columns = columns.unionByName(without.join(k1.select("table_name", "column_name"), "table_name").select(columns.columns)).distinct()
    line = F.concat(F.lit("- "), "table_name", F.lit("."), "column_name", F.lit(" ["), F.coalesce("category", F.lit("other")), F.lit("] "), F.coalesce("description", F.lit("")), F.when(F.size("sample_values") > 0, F.concat(F.lit("; e.g. "), F.array_join(F.slice("sample_values", 1, 5), ", "), F.lit(" (not a complete domain)"))).otherwise(""))
    columns = columns.join(k1.select("table_name", "column_name", "sample_values"), ["table_name", "column_name"]).join(k3.select("table_name", "column_name", "category"), ["table_name", "column_name"], "left").join(k4.select("table_name", "column_name", "description"), ["table_name", "column_name"], "left")
    columns = columns.select("question_id", line.alias("line"), F.lit(2).alias("part"))
    touching = tables.join(k6.select(F.explode(F.array("source_table", "target_table")).alias("table_name"), F.format_string("- %s.%s -> %s.%s (%s)", "source_table", "source_column", "target_table", "target_column", "relationship_type").alias("line")), "table_name").select("question_id", "line", F.lit(3).alias("part")).distinct()
    parts = columns.unionByName(touching)
    if k5 is not None:
        meaning = F.concat(F.lit("- "), "table_name", F.lit(": "), "description")
        parts = parts.unionByName(tables.join(k5.select("table_name", "description"), "table_name").select("question_id", meaning.alias("line"), F.lit(1).alias("part")))
    if k2 is not None:
        known = k2.first()  # one row
        parts = parts.unionByName(tables.select("question_id").distinct().select("question_id", F.lit(f"Domain: {known['description']}").alias("line"), F.lit(0).alias("part")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"])
    return parts.groupBy("question_id").agg(F.array_join(lines, "\n").alias("digest"))


#: Limits of the four complexity levels; features of 0 are forbidden.
LEVELS = {
    1: {"tables": 1, "conditions": 3, "joins": 0, "group_columns": 0, "subqueries": 0, "unions": 0, "windows": 0, "ctes": 0, "recursive": 0},
    2: {"tables": 3, "conditions": 5, "joins": 2, "group_columns": 3, "subqueries": 0, "windows": 0, "ctes": 0, "recursive": 0},
    3: {"tables": 5, "joins": 4, "subqueries": 3, "depth": 2, "windows": 0, "ctes": 0, "recursive": 0},
    4: {},
}


def level_problems(shape: dict[str, int], level: int) -> list[str]:
    """What a statement's shape has beyond its level; the highest level asks for a window, a CTE or recursion."""
    found = [f"{k}: {shape[k]} of {most}" for k, most in LEVELS[level].items() if shape[k] > most]
    if level == 4 and not (shape["windows"] or shape["ctes"] or shape["recursive"]):
        found.append("no advanced feature")
    return found
