"""Diagnose, retrieve, correct: up to k passes over the samples that are still open, all of them at once in each pass."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import checks, guard
from .annotate import RuleAnnotator


@dataclass
class Sample:
    question_id: str
    question: str
    sql: str
    think: dict = field(default_factory=dict)
    iterations: list[dict] = field(default_factory=list)
    outcome: guard.Outcome | None = None
    errors: list[dict] = field(default_factory=list)
    closed: str | None = None
    original: str = ""


@dataclass
class Knowledge:
    k1: DataFrame
    k2: DataFrame
    k3: DataFrame
    k4: DataFrame
    k5: DataFrame
    k6: DataFrame


Reviewer = Callable[[list[Sample]], DataFrame | None]


#: Seconds that a statement may run.
SECONDS = 60.0


def run_statements(spark: SparkSession, samples: list[Sample], seconds: float | None = SECONDS) -> None:
    """Each sample's statement is run, unless it has run already."""
    new = [s for s in samples if s.outcome is None or s.outcome.sql != s.sql]
    found = guard.execute_all(spark, {str(i): s.sql for i, s in enumerate(new)}, seconds=seconds)
    for i, s in enumerate(new):
        s.outcome = found[str(i)]


def diagnose(spark: SparkSession, samples: list[Sample], knowledge: Knowledge, reviewer: Reviewer | None = None, seconds: float | None = SECONDS) -> dict[str, list[dict]]:
    """Errors by sample: all checks run as joins over all samples' facts; what fails one check still meets the others."""
    facts = checks.FactTables(spark, {s.question_id: s.sql for s in samples})
    run_statements(spark, samples, seconds)
    found = checks.check_columns(facts.columns, knowledge.k1).unionByName(checks.check_joins(facts.joins, knowledge.k6)).unionByName(checks.check_aggregates(facts.aggregates, knowledge.k3))
    # a statement that can't be analysed can't run either; its class is known from the analysis
    analysed = {s.question_id: s.outcome for s in samples if s.question_id in facts.facts}
    found = found.unionByName(facts.failed).unionByName(checks.check_execution(spark, analysed))
    if reviewer is not None:
        questions = spark.createDataFrame([(s.question_id,) for s in samples], "question_id string")
        try:
            issues = reviewer(samples)
            found = found.unionByName(checks.review(questions, issues)) if issues is not None else found
        except Exception as e:  # a reviewer may be a remote service; its failure is a finding of its own
            found = found.unionByName(checks.review_failed(questions, str(e)[:200]))
    by: dict[str, list[dict]] = defaultdict(list)
    for r in checks.classified(found).distinct().orderBy("question_id", "type", "detail").collect():
        by[r["question_id"]].append(r.asDict())
    return by


def refine(spark: SparkSession, samples: list[Sample], knowledge: Knowledge, annotator: RuleAnnotator, max_iterations: int = 3, reviewer: Reviewer | None = None, seconds: float | None = SECONDS) -> list[Sample]:
    """Repair statements until nothing is found, at most ``max_iterations`` times; questions are never edited."""
    k1: dict[str, list[str]] = defaultdict(list)
    for r in knowledge.k1.select("table_name", "column_name").collect():
        k1[r[0]].append(r[1])
    keys = {}
    for r in knowledge.k6.where("source_column IS NOT NULL").collect():
        keys[r["source_table"], r["target_table"]] = r["source_column"], r["target_column"]
        keys[r["target_table"], r["source_table"]] = r["target_column"], r["source_column"]
    for s in samples:
        s.original = s.original or s.sql
    for k in range(max_iterations + 1):
        left = [s for s in samples if s.closed is None]
        if not left:
            break
        found = diagnose(spark, left, knowledge, reviewer, seconds)
        for s in left:
            s.errors = found.get(s.question_id, [])
            step = {"iteration": k, "sql_before": s.sql, "sql_after": s.sql, "errors": s.errors}
            if not s.errors:
                s.closed = "verified"
            elif any(e["type"] == "semantic_review_failed" for e in s.errors):
                s.closed = "semantic_review_failed"
            elif any(e["artifact"] == "q" for e in s.errors):
                s.closed = "rejected_question_invalid"
            elif k == max_iterations:
                s.closed = "max_iterations_reached"
            else:
                s.sql = annotator.correct(s.sql, s.errors, k1, keys)
                step["sql_after"] = s.sql
            s.iterations.append(step | {"action": s.closed or "corrected"})
    return samples


TRACED = ("type", "category", "detector", "semantic_class", "detail")


def traces(spark: SparkSession, samples: list[Sample]) -> DataFrame:
    """The audit table: decisions with all iterations."""
    from pyspark.sql import functions as F

    from .corpus import TRACE, admit

    rows = []
    for s in samples:
        steps = [(i["iteration"], i["action"], i["sql_before"], i["sql_after"], [tuple(e[c] for c in TRACED) for e in i["errors"]]) for i in s.iterations]
        q = sum(e["artifact"] == "q" for e in s.errors)
        rows.append((s.question_id, s.original, s.sql, bool(s.outcome and s.outcome.success), q, len(s.errors) - q, steps))
    steps_type = TRACE.split("iterations ", 1)[1]
    df = spark.createDataFrame(rows, f"question_id string, original_sql string, final_sql string, executable boolean, question_errors int, other_errors int, iterations {steps_type}")
    return admit(df).select("question_id", "original_sql", "final_sql", "decision", "decision_reason", F.col("iterations"))
