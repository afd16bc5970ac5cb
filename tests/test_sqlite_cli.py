"""SQLite files as tables, and the commands over them."""

import os
import shutil
import sqlite3

import pytest

from sparkloom import cli
from sparkloom.engine import LAYERS, QUESTIONS, RESULTS, Engine, Settings
from sparkloom.operators import corpus, workload
from sparkloom.sources.catalog import Catalog
from sparkloom.sources.sqlite import Range, SqliteReader, kind_of, pushed, read_sqlite, holds
from sparkloom.sources.store import JsonStore


@pytest.fixture
def shop(tmp_path):
    path = tmp_path / "spider/databases/shop/shop.sqlite"
    path.parent.mkdir(parents=True)
    c = sqlite3.connect(path)
    c.executescript(
        "CREATE TABLE client (client_id INTEGER PRIMARY KEY, name TEXT, grade VARCHAR(3), balance REAL);"
        "CREATE TABLE sale (sale_id INTEGER PRIMARY KEY, client_id INT REFERENCES client(client_id), amount NUMERIC, day DATE, note BLOB);"
        "CREATE TABLE empty_one (x INT);"
    )
    c.executemany("INSERT INTO client VALUES (?, ?, ?, ?)", [(i, f"n{i}", "abc"[i % 3], i * 10.5) for i in range(1, 61)])
    c.executemany("INSERT INTO sale VALUES (?, ?, ?, ?, ?)", [(i * 7, 1 + i % 60, i if i else "odd", "2024-01-01", b"x") for i in range(200)])
    c.commit()
    c.close()
    return path


def test_affinity():
    assert [kind_of(x) for x in ("INT", "BIGINT", "POINT", "DECIMAL(8,2)", "VARCHAR(9)", "BLOB", "", None, "BOOLEAN")] == ["bigint", "bigint", "string", "double", "string", "binary", "string", "string", "boolean"]


def test_reading(spark, shop):
    sale = read_sqlite(spark, str(shop), "sale", 5)
    assert dict(sale.dtypes) == {"sale_id": "bigint", "client_id": "bigint", "amount": "double", "day": "string", "note": "binary"}
    assert sale.count() == 200 and sale.rdd.getNumPartitions() == 5
    assert sale.where("amount IS NULL").count() == 1 and sale.agg({"amount": "sum"}).first()[0] == sum(range(200))
    assert read_sqlite(spark, str(shop), "empty_one").count() == 0
    c = Catalog.of_sqlite(spark, str(shop))
    assert c.name == "shop" and c.primary["client"] == ["client_id"] and c.foreign == {("sale", "client_id"): ("client", "client_id")}


def test_engine_over_sqlite(spark, shop):
    engine = Engine(spark, Catalog.of_sqlite(spark, str(shop)), settings=Settings(batch_size=8))
    k = engine.analyze()
    assert {(r.source_table, r.target_table) for r in k.k6.collect()} == {("sale", "client")}
    traces = engine.diagnose(engine.generate(12))
    assert traces.where("decision = 'accepted'").count() == traces.count() > 0


def test_commands(spark, shop, tmp_path, capsys):
    root = str(tmp_path)
    cli.main(["list-dbs", "-b", "spider", "--db-root", root], spark)
    assert "shop" in capsys.readouterr().out
    cli.main(["analyze", "--sqlite", str(shop), "--history-dir", f"{root}/h"], spark)
    cli.main(["generate", "--sqlite", str(shop), "-n", "4", "-o", f"{root}/samples", "--history-dir", f"{root}/h"], spark)
    cli.main(["diagnose", "--sqlite", str(shop), "-i", f"{root}/samples", "-o", f"{root}/out", "--history-dir", f"{root}/h"], spark)
    cli.main(["audit-summary", "--history-dir", f"{root}/h"], spark)
    assert "accepted" in capsys.readouterr().out
    for _ in range(2):
        cli.main(["run-benchmark", "-b", "spider", "--db-root", root, "--total", "3", "--batch-size", "3", "--output-root", f"{root}/o"], spark)
        assert "shop: 3 accepted" in capsys.readouterr().out
    with pytest.raises(workload.LeakageError):
        cli.sqlite_path(root, "spider", "concert_singer")
    with pytest.raises(FileNotFoundError):
        cli.sqlite_path(root, "spider", "academic")


def test_resumed_runs_keep_what_was_accepted(spark, shop, tmp_path, capsys, monkeypatch):
    root = str(tmp_path)
    args = ["run-benchmark", "-b", "spider", "--db-root", root, "--batch-size", "3", "--output-root", f"{root}/o"]
    cli.main([*args, "--total", "3"], spark)
    first = {r.question_id for r in corpus.load(spark, f"{root}/o/spider/shop/training").collect()}
    layer = os.path.join(root, "o/spider/shop/history/schema_extraction.jsonl")
    made = os.stat(layer).st_mtime_ns
    # the second run breaks off after its first batch
    whole = Engine.diagnose
    calls = []

    def once(self, samples):
        if calls:
            raise RuntimeError("lost")
        calls.append(1)
        return whole(self, samples)

    monkeypatch.setattr(Engine, "diagnose", once)
    cli.main([*args, "--total", "9"], spark)
    assert "RuntimeError: lost" in capsys.readouterr().out
    monkeypatch.setattr(Engine, "diagnose", whole)
    cli.main([*args, "--total", "9"], spark)
    assert "shop: 9 accepted" in capsys.readouterr().out
    ids = [r.question_id for r in corpus.load(spark, f"{root}/o/spider/shop/training").collect()]
    assert len(ids) == len({*ids}) == 9 and first < {*ids} and os.stat(layer).st_mtime_ns == made
    history = JsonStore(spark, f"{root}/o/spider/shop/history")
    asked, results = history.load("questions", QUESTIONS), history.load("sql_results", RESULTS)
    assert {*ids} <= {r.question_id for r in asked.collect()} and results.where("success").count() >= 9
    # without any accepted sample the old logs go
    shutil.rmtree(f"{root}/o/spider/shop/training")
    cli.main([*args, "--total", "2"], spark)
    assert history.load("questions", QUESTIONS).count() == 2


def test_reused_knowledge_is_what_was_made(spark, shop, tmp_path):
    store = JsonStore(spark, f"{tmp_path}/k")
    one, two = Engine(spark, Catalog.of_sqlite(spark, str(shop)), store), Engine(spark, Catalog.of_sqlite(spark, str(shop)), store)
    a, b = one.analyze(), two.analyze(reuse=True)
    for name in LAYERS:
        assert sorted(map(repr, getattr(a, name).collect())) == sorted(map(repr, getattr(b, name).collect()))


def test_sqlite_gets_columns_and_conditions(spark, shop, tmp_path):
    sale = read_sqlite(spark, str(shop), "sale", 3, ["sale_id", "amount"])
    assert sale.columns == ["sale_id", "amount"]
    with pytest.raises(Exception, match="no column nothing"):
        read_sqlite(spark, str(shop), "sale", 3, ["nothing"]).count()
    whole = read_sqlite(spark, str(shop), "sale").cache()
    for where in ([("amount", ">", 150.0)], [("amount", "=", 7.0), ("sale_id", "<", 60)], [("amount", "is null", None)], [("amount", "is not null", None), ("sale_id", ">=", 1386)], [("day", "=", "2024-01-01")], [("day", ">", "2024")], [("sale_id", "in", [0, 7, 8])]):
        got = read_sqlite(spark, str(shop), "sale", 3, where=where)
        expected = whole
        for c in where:
            expected = expected.where(holds(c))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect())), where
    assert read_sqlite(spark, str(shop), "sale", 3, ["day"], [("sale_id", "<", 70)]).columns == ["day"]
    whole.unpersist()
    columns = {"sale_id": "bigint", "amount": "double", "day": "string", "note": "binary"}
    conditions = [("amount", ">", 150.0), ("day", "=", "it's"), ("sale_id", "in", [1, 2]), ("note", "is null", None), ("amount", "<", float("nan"))]
    reader = SqliteReader(str(shop), "sale", 1, list(columns.items()), [x for c in conditions if (x := pushed(c, columns))])
    assert reader.statement(Range(1, 9)) == (
        'SELECT "sale_id", "amount", "day", "note" FROM "sale" WHERE rowid BETWEEN 1 AND 9'
        " AND (\"amount\" COLLATE BINARY > 150.0 OR (typeof(\"amount\") NOT IN ('integer', 'real') AND \"amount\" IS NOT NULL))"
        " AND (\"day\" COLLATE BINARY = 'it''s' OR (typeof(\"day\") NOT IN ('text') AND \"day\" IS NOT NULL))"
        " AND (\"sale_id\" COLLATE BINARY IN (1, 2) OR (typeof(\"sale_id\") NOT IN ('integer') AND \"sale_id\" IS NOT NULL))"
    )
    assert sum(1 for _ in reader.read(Range(1, 9000))) == 0


def test_conditions_lose_no_row_of_odd_classes(spark, tmp_path):
    """Values of other classes than their column's type: what SQLite sends is what Spark would keep of all rows."""
    path = tmp_path / "odd.sqlite"
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE t (i INT, r REAL, s TEXT COLLATE NOCASE, u)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(1, 1.5, "a", "x"), ("7", "2", 5, 5), ("odd", "odd", b"a", 5.0), (2.5, 3, "A", None), (None, None, None, b"5"), (3.0, b"1", "b", "5")])
    c.commit()
    c.close()
    t = read_sqlite(spark, str(path), "t", 2)
    every = spark.createDataFrame(t.collect(), t.schema)
    for c in (("i", "=", 7), ("i", ">", 1), ("i", "is null", None), ("i", "is not null", None), ("r", ">=", 2.0), ("r", "<", 2.0), ("r", "is null", None), ("s", "=", "a"), ("s", ">", "A"), ("s", "=", "5"), ("u", "=", "5"), ("u", "<=", "5"), ("i", "in", [1, 3]), ("u", "in", ["5", "x"]), ("s", "is not null", None)):
        assert sorted(map(repr, read_sqlite(spark, str(path), "t", 2, where=[c]).collect())) == sorted(map(repr, every.where(holds(c)).collect())), c
