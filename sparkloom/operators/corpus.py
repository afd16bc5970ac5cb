"""Admission, export, import and audit of question-SQL-rationale samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import JsonStore, MemoryStore

METADATA = "struct<main_scenario:string,sub_scenario:string,complexity_level:int,use_case:string>"
THINK = f"struct<focus:string,metadata:{METADATA},table_selection:struct<tables_used:array<string>,reasoning:string>,column_selection:struct<columns_used:array<struct<name:string,type:string,operation:string,purpose:string>>>,sql_strategy:struct<operations:array<string>,approach:string,no_need:array<string>>,expected_output:string>"
TRAINING = f"question_id string, question string, think {THINK}, answer string"
TRACE_ERROR = "struct<type:string,category:string,detector:string,semantic_class:string,detail:string>"
TRACE = f"question_id string, original_sql string, final_sql string, decision string, decision_reason string, iterations array<struct<iteration:int,action:string,sql_before:string,sql_after:string,errors:array<{TRACE_ERROR}>>>"


def admit(samples: DataFrame) -> DataFrame:
    """samples (executable, question_errors, other_errors) with decision and reason; the first rule that fits."""
    decision = F.when(~F.col("executable"), "rejected").when(F.col("question_errors") > 0, "rejected").when(F.col("other_errors") > 0, "unresolved").otherwise("accepted")
    reason = F.when(~F.col("executable"), "final_sql_not_executable").when(F.col("question_errors") > 0, "question_invalid_unrepairable").when(F.col("other_errors") > 0, "diagnosis_errors_remain_after_limit").otherwise("executable_and_no_detected_errors")
    return samples.withColumns({"decision": decision, "decision_reason": reason})


def export(samples: DataFrame, path: str, accepted_only: bool = True, append: bool = False) -> None:
    """Training records (question_id, question, think, answer) as JSON lines."""
    rows = samples.where("decision = 'accepted'") if accepted_only else samples
    rows.select("question_id", "question", "think", "answer").write.mode("append" if append else "overwrite").json(path)


def publish(store: JsonStore | MemoryStore, path: str) -> None:
    """Put the accepted samples of committed batches under a folder, each batch once: it is written aside, renamed to its name, and noted."""
    for b in store.batches():
        if store.published(b):
            continue
        spark = SparkSession.active()
        aside, target = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{x}") for x in (f"_{b}", f"batch={b}"))
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(target):
            store.batch(b, "training", TRAINING).select("question_id", "question", "think", "answer").write.mode("overwrite").json(f"{path}/_{b}")
            if not files.rename(aside, target):
                raise OSError(f"{path}/batch={b} can't be put in place")
        store.published(b, now=True)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Training records with their rationale, of batches or not; blank and malformed lines are left out."""
    return spark.read.schema(TRAINING).option("recursiveFileLookup", "true").option("mode", "DROPMALFORMED").json(path).where("question_id IS NOT NULL AND answer IS NOT NULL")


def _errors(traces: DataFrame) -> DataFrame:
    steps = traces.select("question_id", F.explode("iterations").alias("i"))
    return steps.select("question_id", F.explode("i.errors").alias("e")).select("question_id", "e.*")


def audit(traces: DataFrame) -> DataFrame:
    """(measure, value, n, percentage): decisions, corrected samples, and errors by type, category, detector and class."""
    total = traces.agg(F.count("*").alias("total"))
    none = F.lit(None).cast("double")
    decisions = traces.groupBy("decision").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(F.lit("decision").alias("measure"), F.col("decision").alias("value"), "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percentage"))
    corrected = traces.where(F.exists("iterations", lambda i: i["action"] == "corrected")).agg(F.count("*").alias("n")).select(F.lit("corrected").alias("measure"), F.lit("samples").alias("value"), "n", none.alias("percentage"))
    out = decisions.unionByName(corrected)
    errors = _errors(traces)
    for measure, column in (("error_type", "type"), ("category", "category"), ("detector", "detector"), ("semantic_class", "semantic_class")):
        counts = errors.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
        out = out.unionByName(counts.select(F.lit(measure).alias("measure"), "value", "n", none.alias("percentage")))
    return out


def manifest(traces: DataFrame) -> DataFrame:
    return traces.select("question_id", "decision", "decision_reason", F.size("iterations").alias("diagnosis_iterations"))


def triples(df: DataFrame, predicate: str | None = None, subject: str | None = None) -> DataFrame:
    """Rows (subject, predicate, object) of a graph of statements, filtered."""
    rows = df.select("subject", "predicate", "object")
    rows = rows if predicate is None else rows.where(F.col("predicate") == predicate)
    return rows if subject is None else rows.where(F.col("subject") == subject)
