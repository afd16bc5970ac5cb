"""Text that a language model would write, behind a replaceable seam.

The default annotator works by rules and needs no network: its questions and
SQL come from templates over the knowledge base, its review and corrections from
the checks' findings. It is a substitute, not the quality of a model. A model is
plugged in by another object with these methods, or by :func:`annotated`, which
sends prompts in Arrow batches from the executors.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import checkpointed
from ..sources.store import JsonStore, MemoryStore


def unwrapped(answer: str) -> str:
    """An answer without its thoughts and code fences."""
    answer = re.sub(r"(?s)<think>.*?</think>", "", answer)
    return re.sub(r"(?s)\A\s*```\w*[ \t]*\n(.*?)\n?```\s*\Z", r"\1", answer).strip()


def as_json(answer: str) -> dict | None:
    text = unwrapped(answer)
    a, b = text.find("{"), text.rfind("}")
    try:
        found = json.loads(text[a : b + 1]) if 0 <= a < b else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


ANSWERS = "digest string, answer string, error string"


@dataclass(frozen=True)
class Calls:
    """How a model is called: tries for a batch of prompts, seconds before the second (doubled for each one more), and seconds that a call may take."""

    tries: int = 3
    wait: float = 1.0
    seconds: float | None = 1200.0


def _asked(client: Callable[[list[str]], list[str]], prompts: list[str], calls: Calls) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each prompt; a batch that fails is asked prompt by prompt in its last try."""

    def call(some: list[str]) -> list[str]:
        if calls.seconds is None:
            return client(some)
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(client, some).result(calls.seconds)
        finally:
            pool.shutdown(wait=False)  # a call that hangs is left behind

    error = ""
    for k in range(calls.tries - 1):
        try:
            found = call(prompts)
            if len(found) == len(prompts):
                return [(unwrapped(a), None) for a in found]
            error = f"{len(found)} answers to {len(prompts)} prompts"
        except Exception as e:  # whatever a remote service does wrong is tried again and then told
            error = f"{type(e).__name__}: {e}"[:300]
        time.sleep(calls.wait * 2**k)
    out: list[tuple[str | None, str | None]] = []
    for p in prompts:
        try:
            out.append((unwrapped(call([p])[0]), None))
        except Exception as e:  # as above, for this prompt alone
            out.append((None, f"{type(e).__name__}: {e}"[:300] or error))
    return out


def annotated(rows: DataFrame, prompt: str, client: Callable[[list[str]], list[str]], column: str = "answer", store: JsonStore | MemoryStore | None = None, calls: Calls = Calls()) -> DataFrame:
    """rows with a model's answer to each prompt; ``client`` runs on executors and takes a batch of prompts.

    Equal prompts are asked once. With a store, answers are kept in its layer
    ``answers`` by the SHA-256 of their prompts, and prompts with an answer there
    aren't asked again. A prompt that gets no answer has null; what went wrong is kept
    with it, and it is asked again another time. A null prompt has no answer.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _asked(client, batch["prompt"].tolist(), calls) if len(batch) else []
            yield pd.DataFrame({"digest": batch["digest"], "answer": [a for a, _ in found], "error": [e for _, e in found]}, dtype=object)

    digest = F.sha2(F.col(prompt), 256)
    wanted = rows.select(digest.alias("digest"), F.col(prompt).alias("prompt")).where("prompt IS NOT NULL").dropDuplicates(["digest"])
    if store is None:
        answers = wanted.mapInPandas(run, ANSWERS)
    else:
        if store.exists("answers"):
            wanted = wanted.join(store.load("answers", ANSWERS).where("error IS NULL").select("digest"), "digest", "left_anti")
        store.append("answers", checkpointed(wanted.mapInPandas(run, ANSWERS)))
        answers = store.load("answers", ANSWERS)
    answers = answers.where("error IS NULL").dropDuplicates(["digest"]).select(F.col("digest").alias("_digest"), F.col("answer").alias(column))
    return rows.join(answers, digest == F.col("_digest"), "left").drop("_digest")


def strings(json_array: Column, name: str = "name") -> Column:
    """An array of strings or of objects, in JSON, as strings (of objects, their ``name``)."""
    items = F.from_json(json_array, "array<string>")
    return F.filter(F.transform(items, lambda x: F.coalesce(F.get_json_object(x, f"$.{name}"), x)), lambda x: x.isNotNull() & (F.length(x) > 0))


def column_descriptions(k1: DataFrame, k3: DataFrame) -> DataFrame:
    """K4: a sentence for each column."""
    words = F.initcap(F.regexp_replace("column_name", "[_]+", " "))
    text = F.concat(words, F.lit(": "), "category", F.lit(" of type "), F.col("k1.data_type"), F.when(F.size("sample_values") > 0, F.concat(F.lit(", e.g. "), F.array_join(F.slice("sample_values", 1, 3), ", "))).otherwise(""))
    joined = k1.alias("k1").join(k3.drop("data_type"), ["table_name", "column_name"])
    return joined.select("table_name", "column_name", text.alias("description"), "category", F.lit(0.8).alias("confidence"), F.lit("rule").alias("source"), F.col("k1.data_type").alias("data_type"), "nullable", "primary_key")


def table_descriptions(patterns: DataFrame, keys: DataFrame) -> DataFrame:
    """K5: a sentence for each table."""
    text = F.concat(F.initcap("table_name"), F.lit(": a "), F.regexp_replace("business_type", "_", " "), F.lit(" of pattern "), "pattern", F.when(F.size("key_columns") > 0, F.concat(F.lit(", keyed by "), F.array_join("key_columns", ", "))).otherwise(""))
    return patterns.join(keys, "table_name").select("table_name", text.alias("description"), "business_type", F.lit(0.8).alias("confidence"), "key_columns")


def domain(k1: DataFrame, name: str) -> DataFrame:
    """K2: one row that lists the tables."""
    tables = F.array_join(F.array_sort(F.collect_set("table_name")), ", ")
    concepts = F.array_sort(F.collect_set("table_name"))
    return k1.agg(tables.alias("t"), concepts.alias("business_concepts")).select(F.lit(name).alias("domain_type"), F.concat(F.lit("Records of "), "t").alias("description"), "business_concepts", F.array(F.lit("column names start with the table's letter")).alias("naming_patterns"))


@dataclass(frozen=True)
class Field:
    table: str
    column: str
    category: str
    sample: str | None = None


@dataclass(frozen=True)
class Draft:
    question: str
    sql: str
    focus: str
    tables: tuple[str, ...]
    columns: tuple[tuple[str, str, str], ...]
    operations: tuple[str, ...]


class RuleAnnotator:
    """Questions and SQL from templates over categorised fields and key relations."""

    def __init__(self, fields: list[Field], relations: list[tuple[str, str, str, str]]):
        self.fields, self.relations = fields, sorted(relations)

    def _pick(self, category: str, n: int, table: str | None = None) -> Field | None:
        found = [f for f in self.fields if f.category == category and (table is None or f.table == table)]
        return found[n % len(found)] if found else None

    def draft(self, task: dict) -> Draft | None:
        """A question and its SQL for a task (number, level and use case); None where the tables have no fields for it."""
        n, level, case = task["task_id"], task["complexity_level"], task["use_case"]
        if task["main_scenario"] == "multi_table_query" or case == "relationship_analysis":
            if level > 1 and self.relations:
                return self._joined(n, level)
        group, measure = self._pick("dimension", n) or self._pick("text", n), None
        if group:
            measure = self._pick("measure", n, group.table)
        if group is None or measure is None:
            measure = self._pick("measure", n)
            group = self._pick("identifier", n, measure.table) if measure else None
        if group is None or measure is None:
            return None
        g, m, t = group.column, measure.column, group.table
        used = ((f"{t}.{g}", group.category, "group"), (f"{t}.{m}", measure.category, "measure"))
        if level == 1:
            if case == "data_filtering":
                return Draft(f"Which {t} have {m} above 100?", f"SELECT {g}, {m} FROM {t} WHERE {m} > 100 ORDER BY {m} DESC, {g} LIMIT 20", case, (t,), used, ("WHERE", "ORDER BY"))
            if case == "ranking_analysis":
                return Draft(f"What are the ten highest values of {m} in {t}?", f"SELECT {g}, {m} FROM {t} ORDER BY {m} DESC, {g} LIMIT 10", case, (t,), used, ("ORDER BY", "LIMIT"))
            return Draft(f"List the distinct values of {g} in {t}.", f"SELECT DISTINCT {g} FROM {t} ORDER BY {g} LIMIT 50", case, (t,), used[:1], ("DISTINCT",))
        if level == 2:
            return Draft(f"What is the average {m} of {t} by {g}, where there are at least two?", f"SELECT {g}, COUNT(*) AS n, AVG({m}) AS mean FROM {t} GROUP BY {g} HAVING COUNT(*) >= 2 ORDER BY n DESC, {g} LIMIT 20", case, (t,), used, ("GROUP BY", "HAVING"))
        if level == 3:
            return Draft(f"Which {t} have {m} above the average of all?", f"SELECT {g}, {m}, CASE WHEN {m} > 1000 THEN 'high' ELSE 'low' END AS band FROM {t} WHERE {m} > (SELECT AVG({m}) FROM {t}) ORDER BY {m} DESC, {g} LIMIT 20", case, (t,), used, ("SUBQUERY", "CASE"))
        return Draft(f"Rank {t} by {m} within each {g}.", f"WITH ranked AS (SELECT {g}, {m}, ROW_NUMBER() OVER (PARTITION BY {g} ORDER BY {m} DESC) AS place FROM {t}) SELECT {g}, {m}, place FROM ranked WHERE place <= 3 ORDER BY {g}, place LIMIT 60", case, (t,), used, ("CTE", "WINDOW"))

    def _joined(self, n: int, level: int) -> Draft | None:
        s, c, t, k = self.relations[n % len(self.relations)]
        m = self._pick("measure", n, s) or self._pick("measure", n, t)
        g = self._pick("dimension", n, t) or self._pick("text", n, t) or Field(t, k, "identifier")
        value = f"SUM({'s' if m and m.table == s else 't'}.{m.column})" if m else "COUNT(*)"
        used = ((f"{s}.{c}", "identifier", "join"), (f"{t}.{k}", "identifier", "join"), (f"{t}.{g.column}", g.category, "group"))
        body = f"SELECT t.{g.column} AS name, {value} AS total FROM {s} s JOIN {t} t ON s.{c} = t.{k}"
        if level == 3:
            sql = f"{body} WHERE EXISTS (SELECT 1 FROM {t} u WHERE u.{k} = s.{c}) GROUP BY t.{g.column} ORDER BY total DESC, name LIMIT 20"
        elif level == 4:
            sql = f"WITH totals AS ({body} GROUP BY t.{g.column}) SELECT name, total, RANK() OVER (ORDER BY total DESC) AS place FROM totals ORDER BY place, name LIMIT 20"
        else:
            sql = f"{body} GROUP BY t.{g.column} ORDER BY total DESC, name LIMIT 20"
        return Draft(f"What is the total of {s} for each {g.column} of {t}?", sql, "relationship_analysis", (s, t), used, ("JOIN", "GROUP BY"))

    def correct(self, sql: str, errors: list[dict], k1: dict[str, list[str]], keys: dict[tuple[str, str], tuple[str, str]]) -> str:
        """sql with what the errors name repaired: the nearest column, the relation's keys, COUNT for sums of identifiers."""
        for e in errors:
            detail = e.get("detail") or ""
            if e["type"] == "column_not_found":
                m = re.search(r"name `?(?:\w+`?\.`?)?(\w+)`?", detail) or re.search(r"(\w+)\Z", detail)
                if m and (best := nearest(m[1], sorted({c for cs in k1.values() for c in cs}))):
                    sql = re.sub(rf"\b{re.escape(m[1])}\b", best, sql)
            elif e["type"] == "table_not_found":
                m = re.search(r"view `?(\w+)`?", detail)
                if m and (best := nearest(m[1], sorted(k1))):
                    sql = re.sub(rf"\b{re.escape(m[1])}\b", best, sql)
            elif e["type"] == "aggregation_type_mismatch":
                sql = re.sub(rf"(?i)\b(sum|avg)\s*\(\s*((?:\w+\.)?{re.escape(e['column_name'])})\s*\)", r"COUNT(\2)", sql)
            elif e["type"] == "join_invalid":
                m = re.fullmatch(r"(\w+)\.(\w+) = (\w+)\.(\w+)", detail)
                if m and (found := keys.get((m[1], m[3]))):
                    sql = re.sub(rf"\b{m[2]}(\s*=\s*(?:\w+\.)?){m[4]}\b", rf"{found[0]}\g<1>{found[1]}", sql)
                    sql = re.sub(rf"\b{m[4]}(\s*=\s*(?:\w+\.)?){m[2]}\b", rf"{found[1]}\g<1>{found[0]}", sql)
        return sql


def nearest(word: str, names: list[str]) -> str | None:
    """The name at the least edit distance, if that is below half of the word's length."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    best = min(names, key=lambda n: (distance(word.lower(), n.lower()), n), default=None)
    return best if best is not None and distance(word.lower(), best.lower()) <= max(1, len(word) // 2) else None
