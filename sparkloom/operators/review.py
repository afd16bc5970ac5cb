"""The default reviewer: what rules can tell of a statement's meaning, for want of a language model.

II-1: the question asks for a figure (average, total, number) that the statement
doesn't compute. II-2: the statement joins tables that no known relation connects.
Other classes need a model's judgement and are never reported here.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import checks

if TYPE_CHECKING:
    from .refine import Knowledge, Reviewer, Sample

ISSUE = "question_id string, class string, artifact string, clause string, table_name string, column_name string, detail string, condition string"
#: Words of a question and the functions of which the statement needs one.
FIGURES = (
    (r"\b(average|mean)\b", ("AVG",)),
    (r"\b(total|sum)\b", ("SUM", "COUNT")),
    (r"\b(how many|number of|count of)\b", ("COUNT",)),
)


def figures(asked: DataFrame, computed: DataFrame) -> DataFrame:
    """Issues of class II-1 of (question_id, question), from the functions (question_id, func) that statements really compute."""
    out = asked.limit(0).select("question_id", F.lit("").alias("detail"))
    for words, needed in FIGURES:
        has = computed.where(F.col("func").isin(*needed)).select("question_id").distinct()
        missing = asked.where(F.col("question").rlike(f"(?i){words}")).join(has, "question_id", "left_anti")
        out = out.unionByName(missing.select("question_id", F.concat(F.lit("the question asks for '"), F.lower(F.regexp_extract("question", f"(?i){words}", 1)), F.lit("', which the statement doesn't compute")).alias("detail")))
    none = F.lit(None).cast("string")
    return out.select("question_id", F.lit("II-1").alias("class"), F.lit("s").alias("artifact"), F.lit("SELECT").alias("clause"), none.alias("table_name"), none.alias("column_name"), "detail", F.lit("the figure asked for is computed").alias("condition"))


def unconnected(joins: DataFrame, k6: DataFrame) -> DataFrame:
    """Issues of class II-2 of joins (question_id, left_table, right_table): pairs of different tables without a relation in K6."""
    ends = k6.select(F.least("source_table", "target_table").alias("a"), F.greatest("source_table", "target_table").alias("b")).distinct()
    pairs = joins.where("left_table <> right_table").select("question_id", F.least("left_table", "right_table").alias("a"), F.greatest("left_table", "right_table").alias("b")).distinct()
    found = pairs.join(ends, ["a", "b"], "left_anti")
    return found.select("question_id", F.lit("II-2").alias("class"), F.lit("s").alias("artifact"), F.lit("FROM").alias("clause"), F.col("a").alias("table_name"), F.lit(None).cast("string").alias("column_name"), F.format_string("%s and %s are joined, but no relation connects them", "a", "b").alias("detail"), F.lit("joined tables are related").alias("condition"))


def by_rules(spark: SparkSession, knowledge: Knowledge) -> Reviewer:
    """A reviewer for :func:`refine.refine`."""

    def review(samples: list[Sample]) -> DataFrame:
        facts = checks.FactTables(spark, {s.question_id: s.sql for s in samples})
        # of a statement that can't be analysed nothing is known here; its error is told elsewhere
        asked = spark.createDataFrame([(s.question_id, s.question or "") for s in samples if s.question_id in facts.facts], "question_id string, question string")
        return figures(asked, facts.functions).unionByName(unconnected(facts.joins, knowledge.k6))

    return review
