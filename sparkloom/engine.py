"""The whole run: analyse tables, generate samples, diagnose and admit them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import annotate, checks, corpus, guard, profile, refine, relations, review, semantics, workload
from .sources.catalog import Catalog
from .sources.folders import removed
from .sources.store import JsonStore, MemoryStore
from .sources.tables import healthy

LAYERS = ("k1", "k2", "k3", "k4", "k5", "k6")
QUESTIONS = f"question_id string, question string, think {corpus.THINK}"
RESULTS = "question_id string, sql string, success boolean, row_count long, error string, error_type string"
RELATIONAL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@dataclass
class Settings:
    """What a run may vary."""

    name: str = "warehouse"
    tables: tuple[str, ...] = RELATIONAL
    blocked: tuple[str, ...] = ("aid_info",)
    max_iterations: int = 3
    batch_size: int = 25
    seed: int = 1
    benchmark: str | None = None
    statement_seconds: float | None = refine.SECONDS


class Engine:
    """Analysis, generation and diagnosis over a data folder (or a catalog of tables from elsewhere); without a reviewer, rules review."""

    def __init__(self, spark: SparkSession, source: str | Catalog, store: JsonStore | MemoryStore | None = None, settings: Settings | None = None, reviewer: refine.Reviewer | None = None):
        self.spark = spark
        self.settings, self.store, self.reviewer = settings or Settings(), store or MemoryStore(), reviewer
        self.catalog = source if isinstance(source, Catalog) else Catalog.of_folder(spark, source, self.settings.tables, self.settings.name)
        if self.settings.benchmark:
            workload.assert_train_only(self.settings.benchmark, self.catalog.name)
        if not healthy(spark):
            raise RuntimeError("the session doesn't answer")
        self.catalog.register()
        self.knowledge: refine.Knowledge | None = None
        self.in_batch = False

    def analyze(self, reuse: bool = False) -> refine.Knowledge:
        """K1 to K6; each layer is saved and kept. With reuse, layers that the store holds are read and not made again, if it holds all six."""
        c = self.catalog
        k1 = profile.profile_all(c.frames, self.settings.blocked, c.primary, c.foreign).cache()
        k3 = semantics.classify(k1).cache()
        k4 = annotate.column_descriptions(k1, k3).cache()
        k5 = annotate.table_descriptions(semantics.patterns(k3), semantics.key_columns(k1)).cache()
        k6 = relations.merged(relations.declared(k1, c.foreign), relations.by_name(k1)).cache()
        k2 = annotate.domain(k1, c.name).cache()
        made = dict(zip(LAYERS, (k1, k2, k3, k4, k5, k6), strict=True))
        if reuse and all(map(self.store.exists, LAYERS)):
            made = {name: self.store.load(name, rows.schema).cache() for name, rows in made.items()}
        else:
            for name, rows in made.items():
                self.store.save(name, rows)
        self.knowledge = refine.Knowledge(*made.values())
        return self.knowledge

    def annotator(self) -> annotate.RuleAnnotator:
        k = self.knowledge or self.analyze()
        fields = k.k1.join(k.k3.select("table_name", "column_name", "category"), ["table_name", "column_name"]).orderBy("table_name", "ordinal")
        rows = fields.select("table_name", "column_name", "category").collect()  # one row a column of the catalogue
        keys = k.k6.where("source_column IS NOT NULL").select("source_table", "source_column", "target_table", "target_column").collect()
        return annotate.RuleAnnotator([annotate.Field(*r) for r in rows], [tuple(r) for r in keys])

    def generate(self, count: int, start: int = 0) -> list[refine.Sample]:
        """Up to ``count`` samples from task ``start`` on; drafts that name unknown tables or columns are left out."""
        k, annotator = self.knowledge or self.analyze(), self.annotator()
        tasks = [r.asDict() for r in workload.tasks(self.spark, count, start, self.settings.seed).orderBy("task_id").collect()]
        drafts = {f"q{t['task_id']:06d}": (t, d) for t in tasks if (d := annotator.draft(t))}
        references = [(q, t, None) for q, (_, d) in drafts.items() for t in d.tables] + [(q, *c[0].split(".")) for q, (_, d) in drafts.items() for c in d.columns]
        bad = set()
        if references:
            named = self.spark.createDataFrame(references, "question_id string, table_name string, column_name string")
            bad = {r[0] for r in checks.unknown_references(named, k.k1).collect()}
        samples = []
        for q, (t, d) in drafts.items():
            if q in bad:
                continue
            meta = {c: t[c] for c in ("main_scenario", "sub_scenario", "complexity_level", "use_case")}
            think = {"focus": d.focus, "metadata": meta, "table_selection": {"tables_used": list(d.tables), "reasoning": "tables that hold the fields asked for"}, "column_selection": {"columns_used": [{"name": n, "type": c, "operation": o, "purpose": o} for n, c, o in d.columns]}, "sql_strategy": {"operations": list(d.operations), "approach": "template", "no_need": []}, "expected_output": "a table"}
            samples.append(refine.Sample(q, d.question, d.sql, think))
        return samples

    def summary(self) -> DataFrame:
        """Rows of each knowledge layer."""
        k = self.knowledge or self.analyze()
        return semantics.layer_summary(k1=k.k1, k2=k.k2, k3=k.k3, k4=k.k4, k5=k.k5, k6=k.k6)

    def diagnose(self, samples: list[refine.Sample]) -> DataFrame:
        """The audit table of the samples after refinement; it is appended to the logs, unless a run commits it with its batch."""
        k = self.knowledge or self.analyze()
        refine.refine(self.spark, samples, k, self.annotator(), self.settings.max_iterations, self.reviewer or review.by_rules(self.spark, k), self.settings.statement_seconds)
        traces = refine.traces(self.spark, samples).cache()
        if not self.in_batch:
            self.store.append("diagnosis_trace", traces)
            self.store.append("corpus_manifest", corpus.manifest(traces))
        return traces

    def training_rows(self, samples: list[refine.Sample], traces: DataFrame) -> DataFrame:
        rows = self.spark.createDataFrame([(s.question_id, s.question, s.think, s.sql) for s in samples], corpus.TRAINING)
        return rows.join(traces.select("question_id", "decision"), "question_id")

    def first_results(self, samples: list[refine.Sample]) -> dict[str, DataFrame]:
        """Phase 2: the questions and what their first statements give."""
        questions = self.spark.createDataFrame([(s.question_id, s.question, s.think) for s in samples], QUESTIONS)
        refine.run_statements(self.spark, samples, self.settings.statement_seconds)
        rows = [(s.question_id, s.sql, s.outcome.success, s.outcome.row_count, s.outcome.error, s.outcome.error_type) for s in samples]
        return {"questions": questions, "sql_results": self.spark.createDataFrame(rows, RESULTS)}

    def record(self, samples: list[refine.Sample]) -> None:
        """Phase 2 by itself: its results are appended to the logs."""
        for layer, rows in self.first_results(samples).items():
            self.store.append(layer, rows)

    def tried(self) -> int:
        """The first task that no logged question belongs to; a run that goes on starts there."""
        number = F.max(F.substring("question_id", 2, 18).cast("long")).alias("n")
        last = self.store.load("questions", QUESTIONS).agg(number).first()["n"] if self.store.exists("questions") else None
        return 0 if last is None else last + 1

    def run(self, count: int, output: str | None = None, resume: bool = False) -> DataFrame | None:
        """Analyse, then batches of samples until ``count`` are accepted, at most three times as many tried; the traces, or None without any.

        A batch's questions, first results, traces and accepted samples are committed
        together, then published to the output; a run that stops in between has whole
        batches only. With resume, knowledge and logs of an earlier run are kept: what it
        committed is published if it wasn't, tasks go on after the last one committed, and
        accepted samples are added to the output. Without, logs and output start empty.
        """
        self.analyze(reuse=resume)
        if not resume:
            self.store.restart()
            if output:
                removed(self.spark, output)
        elif output:
            corpus.publish(self.store, output)
        start = self.tried() if resume else 0
        accepted, end, out = 0, start + 3 * count + self.settings.batch_size, None
        while accepted < count and start < end:
            size = min(self.settings.batch_size, count - accepted)
            samples, batch = self.generate(size, start), f"b{start:012d}"
            start += size
            if not samples:
                continue
            layers = self.first_results(samples)
            self.in_batch = True
            try:
                traces = self.diagnose(samples)
            finally:
                self.in_batch = False
            rows = self.training_rows(samples, traces).where("decision = 'accepted'").cache()
            self.store.commit(batch, layers | {"diagnosis_trace": traces, "corpus_manifest": corpus.manifest(traces), "training": rows.drop("decision")})
            if output:
                corpus.publish(self.store, output)
            accepted += rows.count()
            out = traces if out is None else out.unionByName(traces)
        return out
