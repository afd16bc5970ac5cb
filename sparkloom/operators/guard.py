"""Safe execution: only queries, bounded results, a time limit, and errors by class."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

LIMIT = 100
#: Statements that run at once, seconds between two attempts to stop one, and between looks whether it runs.
THREADS, AGAIN, LOOK = 4, 0.5, 0.2
#: Roots of parsed plans that are queries; every other root is refused.
QUERY_ROOTS = frozenset("Aggregate Distinct Except Filter GlobalLimit Intersect LocalLimit Offset OneRowRelation Project Sort SubqueryAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedOffset UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition LateralJoin LocalRelation Join Pivot Unpivot Generate TableSample Sample".split())
#: Spark's error conditions by our error types; anything else is execution_failed.
CONDITIONS = (("PARSE_", "syntax_error"), ("UNRESOLVED_COLUMN", "column_not_found"), ("AMBIGUOUS_REFERENCE", "column_not_found"), ("TABLE_OR_VIEW_NOT_FOUND", "table_not_found"), ("DATATYPE_MISMATCH", "type_error"), ("CAST_INVALID_INPUT", "type_error"))


class NotAQuery(ValueError):
    """The statement would change or reveal something else than a result."""


def error_type(condition: str | None, message: str = "") -> str:
    for start, kind in CONDITIONS:
        if (condition or "").startswith(start):
            return kind
    if not condition:
        text = message.lower()
        for mark, kind in (("no such column", "column_not_found"), ("unknown column", "column_not_found"), ("ambiguous", "column_not_found"), ("no such table", "table_not_found"), ("doesn't exist", "table_not_found"), ("syntax", "syntax_error"), ("type", "type_error"), ("join", "join_invalid")):
            if mark in text:
                return kind
    return "execution_failed"


def parsed(spark: SparkSession, sql: str):
    """The unresolved plan of one statement."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def require_query(spark: SparkSession, sql: str) -> None:
    root = parsed(spark, sql).getClass().getSimpleName()
    if root not in QUERY_ROOTS:
        raise NotAQuery(f"{root} is not a query")


def cleaned(sql: str) -> str:
    """The statement without code fences and without its last semicolon; white space and comments stay as they are."""
    sql = re.sub(r"(?s)\A\s*```\w*[ \t]*\n(.*?)\n?```\s*\Z", r"\1", sql)
    return re.sub(r"[;\s]+\Z", "", sql).strip()


@dataclass
class Outcome:
    sql: str
    success: bool
    columns: list[str] = field(default_factory=list)
    data: list[dict] = field(default_factory=list)
    row_count: int = 0
    truncated: bool = False
    error: str | None = None
    error_type: str | None = None


def query(spark: SparkSession, sql: str) -> DataFrame:
    """The lazy result of a statement that must be a query."""
    sql = cleaned(sql)
    require_query(spark, sql)
    return spark.sql(sql)


@contextmanager
def stopped_after(spark: SparkSession, seconds: float | None) -> Iterator[threading.Event]:
    """Jobs that this thread starts inside are cancelled when the time is up; the event tells whether that was so.

    Time counts from the first task that runs, so a statement that waits behind others
    isn't stopped for them. A statement may start one job after another, so what it
    runs is cancelled again until it ends.
    """
    context, tag, over, late = spark.sparkContext, f"statement-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    status = context._jsc.sc().statusTracker()

    def running() -> bool:
        for job in status.getJobIdsForTag(tag):
            info = status.getJobInfo(job)
            stages = [status.getStageInfo(x) for x in (info.get().stageIds() if info.isDefined() else ())]
            if any(x.isDefined() and x.get().numActiveTasks() + x.get().numCompletedTasks() for x in stages):
                return True
        return False

    def watch() -> None:
        while not running():
            if over.wait(LOOK):
                return
        if not over.wait(seconds):
            late.set()
            while not over.is_set():
                context.cancelJobsWithTag(tag)
                over.wait(AGAIN)

    watcher = threading.Thread(target=watch, daemon=True)
    interrupt = context.getLocalProperty("spark.job.interruptOnCancel")
    context.addJobTag(tag)
    context.setLocalProperty("spark.job.interruptOnCancel", "true")
    if seconds is not None:
        watcher.start()
    try:
        yield late
    finally:
        over.set()
        context.removeJobTag(tag)
        context.setLocalProperty("spark.job.interruptOnCancel", interrupt)


def execute(spark: SparkSession, sql: str, limit: int = LIMIT, seconds: float | None = None) -> Outcome:
    """Run a query and bring at most ``limit`` rows, for at most about ``seconds``; never raises for what the statement does wrong."""
    with stopped_after(spark, seconds) as late:
        try:
            df = query(spark, sql)
            rows = df.limit(limit + 1).collect()
        except NotAQuery as e:
            return Outcome(sql, False, error=str(e), error_type="execution_failed")
        except Exception as e:
            if late.is_set():
                return Outcome(sql, False, error=f"stopped after {seconds:g} seconds", error_type="execution_failed")
            if not isinstance(e, PySparkException):
                raise
            condition = e.getCondition() if hasattr(e, "getCondition") else None
            return Outcome(sql, False, error=str(e).strip().split("\n")[0][:500], error_type=error_type(condition, str(e)))
    data = [r.asDict(recursive=True) for r in rows[:limit]]
    return Outcome(sql, True, df.columns, data, len(data), len(rows) > limit)


def execute_all(spark: SparkSession, statements: dict[str, str], limit: int = LIMIT, seconds: float | None = None, threads: int = THREADS) -> dict[str, Outcome]:
    """Outcomes by name. Some statements run at once, each in a pool of its own where Spark schedules fairly, so a long one holds up no other."""

    def one(item: tuple[str, str]) -> tuple[str, Outcome]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"statement-{threading.get_ident()}")
        name, sql = item
        return name, execute(spark, sql, limit, seconds) if cleaned(sql) else Outcome(sql, False, error="empty statement", error_type="syntax_error")

    with ThreadPoolExecutor(threads) as pool:
        return dict(pool.map(one, statements.items()))


def extract_sql(answer: str) -> tuple[str, dict]:
    """(sql, rationale) of an answer: its outermost JSON object, else a fenced block, else the text itself."""
    import json

    a, b = answer.find("{"), answer.rfind("}")
    if 0 <= a < b:
        try:
            found = json.loads(answer[a : b + 1])
            if isinstance(found, dict) and isinstance(found.get("sql"), str):
                rationale = found.get("rationale")
                return cleaned(found["sql"]), rationale if isinstance(rationale, dict) else {}
        except ValueError:
            pass
    for fence in (r"```sql\s*(.*?)```", r"```\w*\s*(.*?)```"):
        for m in re.finditer(fence, answer, re.S | re.I):
            if re.search(r"(?i)\b(select|with)\b", m[1]):
                return cleaned(m[1]), {}
    return cleaned(answer), {}
