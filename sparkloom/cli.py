"""Commands: list-dbs, analyze, generate, diagnose, run, run-benchmark, audit-summary.

A database is a SQLite file (--sqlite, or root/<benchmark>/databases/<name>/<name>.sqlite)
or a folder of Parquet tables (--folder).
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine, Settings
from .operators import corpus, refine, workload
from .sources.catalog import Catalog
from .sources.store import JsonStore


def session() -> SparkSession:
    return SparkSession.builder.appName("sparkloom").getOrCreate()


def sqlite_path(root: str, benchmark: str, database: str) -> str:
    """The file of a benchmark's database, which must not be kept for evaluation."""
    workload.assert_train_only(benchmark, database)
    path = Path(root, benchmark, "databases", database, f"{database}.sqlite")
    if not path.exists():
        raise FileNotFoundError(path)
    return str(path)


def engine_of(spark: SparkSession, a: argparse.Namespace) -> Engine:
    settings = Settings(max_iterations=a.max_iters, benchmark=a.benchmark)
    store = JsonStore(spark, a.history_dir)
    if a.folder:
        return Engine(spark, a.folder, store, settings)
    path = a.sqlite or sqlite_path(a.db_root, a.benchmark, a.database)
    return Engine(spark, Catalog.of_sqlite(spark, path), store, settings)


def analyzed(engine: Engine, a: argparse.Namespace) -> Engine:
    engine.analyze(reuse=a.reuse_knowledge)
    if a.summary:
        engine.summary().show()
    return engine


def samples_of(rows: DataFrame) -> list[refine.Sample]:
    """Stored samples; bounded by the batch a file holds."""
    return [refine.Sample(r["question_id"], r["question"], r["answer"], r["think"].asDict(recursive=True) if r["think"] else {}) for r in rows.collect()]


LOGS = ("questions", "sql_results", "diagnosis_trace", "corpus_manifest")


def produced(spark: SparkSession, folder: str) -> int:
    """Accepted samples that a training folder holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return corpus.load(spark, folder).count() if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else 0


def run_benchmark(spark: SparkSession, a: argparse.Namespace) -> dict[str, int]:
    """Accepted samples by database of this shard; databases that have theirs already are passed over.

    What earlier runs accepted stays, their knowledge is used again, and tasks go on
    after the last one tried; logs of a database without any accepted sample are
    cleared. A database that fails counts what it has, and the others go on.
    """
    names = [r["database"] for r in workload.list_databases(spark, a.db_root, a.benchmark).collect()][: a.limit or None]
    if not names:
        return {}
    frame = spark.createDataFrame(list(enumerate(names)), "position int, database string")
    quotas = workload.even_split(frame, a.total if a.total else a.count * len(names))
    made = {}
    for r in workload.shard(quotas, a.shard, a.num_shards).orderBy("position").collect():
        out = f"{a.output_root}/{a.benchmark}/{r['database']}"
        store = JsonStore(spark, f"{out}/history")
        corpus.publish(store, f"{out}/training")  # what a stopped run committed
        have = made[r["database"]] = produced(spark, f"{out}/training")
        if have >= r["quota"]:
            continue
        try:
            if not have:
                store.clear(*LOGS)
                store.restart()
            engine = Engine(spark, Catalog.of_sqlite(spark, sqlite_path(a.db_root, a.benchmark, r["database"])), store, Settings(batch_size=a.batch_size, max_iterations=a.max_iters, benchmark=a.benchmark))
            engine.run(r["quota"] - have, f"{out}/training", resume=True)
        except Exception as e:  # one broken database must not end the run; it is named, and tried again by the next run
            print(f"{r['database']}: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
        made[r["database"]] = produced(spark, f"{out}/training")
    return made


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("list-dbs", "analyze", "generate", "diagnose", "run", "run-benchmark", "audit-summary"):
        s = sub.add_parser(name)
        s.add_argument("-b", "--benchmark")
        s.add_argument("-d", "--database")
        s.add_argument("--sqlite")
        s.add_argument("--folder")
        s.add_argument("--db-root", default="datasets")
        s.add_argument("--history-dir", default="history")
        s.add_argument("-n", "--count", type=int, default=10)
        s.add_argument("--total", type=int)
        s.add_argument("-i", "--input")
        s.add_argument("-o", "--output", default="training")
        s.add_argument("--max-iters", type=int, default=3)
        s.add_argument("--batch-size", type=int, default=25)
        s.add_argument("--shard", type=int, default=0)
        s.add_argument("--num-shards", type=int, default=1)
        s.add_argument("--limit", type=int)
        s.add_argument("--output-root", default="output")
        s.add_argument("--reuse-knowledge", action="store_true", help="read K1 to K6 of the history folder if all are there")
        s.add_argument("--summary", action="store_true", help="also show the rows of each knowledge layer")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a, spark = parser().parse_args(args), spark or session()
    if a.command == "list-dbs":
        workload.list_databases(spark, a.db_root, a.benchmark).show(1000, False)
    elif a.command == "audit-summary":
        corpus.audit(JsonStore(spark, a.history_dir).load("diagnosis_trace", corpus.TRACE)).show(1000, False)
    elif a.command == "run-benchmark":
        for name, n in run_benchmark(spark, a).items():
            print(f"{name}: {n} accepted")
    elif a.command == "analyze":
        analyzed(engine_of(spark, a), a).summary().show()
    elif a.command == "generate":
        engine = analyzed(engine_of(spark, a), a)
        samples = engine.generate(a.count)
        rows = [(s.question_id, s.question, s.think, s.sql) for s in samples]
        spark.createDataFrame(rows, corpus.TRAINING).write.mode("overwrite").json(a.output)
    elif a.command == "diagnose":
        engine = analyzed(engine_of(spark, a), a)
        samples = samples_of(corpus.load(spark, a.input))
        traces = engine.diagnose(samples)
        corpus.export(engine.training_rows(samples, traces), a.output)
        corpus.audit(traces).show(1000, False)
    else:
        traces = engine_of(spark, a).run(a.count, a.output, resume=a.reuse_knowledge)
        if traces is not None:
            corpus.audit(traces).show(1000, False)


if __name__ == "__main__":
    main()
