"""Statements that don't end, runs that stop half way, and model calls that fail."""

import json
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.engine import QUESTIONS, RESULTS, Engine, Settings
from sparkloom.operators import annotate, corpus, guard, refine
from sparkloom.sources.store import JsonStore, MemoryStore

ENDLESS = "SELECT count(*) AS n FROM range(0, 3000000000) a JOIN range(0, 3000000000) b ON a.id % 7 = b.id % 7 AND hash(a.id, b.id) = 5"


def test_an_endless_statement_is_stopped_and_others_finish(spark):
    before = time.time()
    found = guard.execute_all(spark, {"long": ENDLESS, "one": "SELECT 1 AS x", "bad": "SELECT nothing FROM nowhere", "empty": " ;", "two": "SELECT sum(id) AS s FROM range(1000)", "drop": "DROP TABLE x"}, seconds=4, threads=3)
    assert time.time() - before < 60
    assert list(found) == ["long", "one", "bad", "empty", "two", "drop"]
    assert not found["long"].success and found["long"].error_type == "execution_failed" and found["long"].error == "stopped after 4 seconds"
    assert found["one"].data == [{"x": 1}] and found["two"].data == [{"s": 499500}]
    assert (found["bad"].error_type, found["empty"].error_type, found["drop"].error_type) == ("table_not_found", "syntax_error", "execution_failed")
    assert spark.range(10).count() == 10 and not spark.sparkContext.getJobTags()
    time.sleep(1)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_an_endless_sample_is_diagnosed(spark, folder):
    engine = Engine(spark, folder, settings=Settings(tables=("nation", "region"), statement_seconds=3, max_iterations=0))
    samples = [refine.Sample("slow", "How many?", ENDLESS), refine.Sample("good", "Which regions are there?", "SELECT r_name FROM region")]
    decided = {r.question_id: (r.decision, r.decision_reason) for r in engine.diagnose(samples).collect()}
    assert decided == {"slow": ("rejected", "final_sql_not_executable"), "good": ("accepted", "executable_and_no_detected_errors")}


class Stop(Exception):
    pass


def stopping(patch, step):
    """Stop a run in its second batch: while a layer is written, before the manifest is in place, or before the samples are published."""
    if step == "published":
        publish = corpus.publish

        def stop(store, path):
            if len(store.batches()) == 2:
                raise Stop
            publish(store, path)

        patch.setattr(corpus, "publish", stop)
    elif step == "manifest":
        placed, seen = JsonStore._placed, []

        def place(self, source, target):
            seen.append(target)
            if len(seen) == 2:
                raise Stop
            placed(self, source, target)

        patch.setattr(JsonStore, "_placed", place)
    else:
        commit, count = JsonStore.commit, []

        def half(self, batch, layers):
            count.append(batch)
            if len(count) < 2:
                return commit(self, batch, layers)
            for layer in sorted(layers):
                layers[layer].write.mode("overwrite").json(f"{self.folder}/_batches/{batch}/{layer}")
                if layer == step:
                    raise Stop

        patch.setattr(JsonStore, "commit", half)


@pytest.mark.parametrize("step", ["training", "manifest", "published"])
def test_a_run_that_stops_goes_on_with_whole_batches(spark, folder, tmp_path, monkeypatch, step):
    make = lambda: Engine(spark, folder, JsonStore(spark, f"{tmp_path}/history"), Settings(tables=("nation", "region", "supplier"), batch_size=2))
    out = f"{tmp_path}/training"
    engine = make()
    with monkeypatch.context() as patch:
        stopping(patch, step)
        with pytest.raises(Stop):
            engine.run(6, out)
    ids = lambda layer, schema: [r.question_id for r in engine.store.load(layer, schema).select("question_id").collect()]
    committed = ids("questions", QUESTIONS)
    assert len(committed) == (4 if step == "published" else 2)
    assert sorted(committed) == sorted(ids("sql_results", RESULTS)) == sorted(ids("diagnosis_trace", corpus.TRACE))
    again = make()
    again.run(2, out, resume=True)
    questions = ids("questions", QUESTIONS)
    assert len(questions) == len(set(questions)) > len(committed)
    assert sorted(questions) == sorted(ids("sql_results", RESULTS)) == sorted(ids("diagnosis_trace", corpus.TRACE))
    accepted = {r.question_id for r in again.store.load("diagnosis_trace", corpus.TRACE).where("decision = 'accepted'").collect()}
    rows = [r.question_id for r in corpus.load(spark, out).collect()]
    assert sorted(rows) == sorted(accepted) and len(rows) >= 4
    assert again.tried() == max(int(q[1:]) for q in questions) + 1


def test_a_new_run_starts_empty(spark, folder, tmp_path):
    make = lambda: Engine(spark, folder, JsonStore(spark, f"{tmp_path}/history"), Settings(tables=("nation", "region", "supplier"), batch_size=2))
    for _ in range(2):
        make().run(2, f"{tmp_path}/training")
        assert corpus.load(spark, f"{tmp_path}/training").count() >= 2
        store = make().store
        questions = [r.question_id for r in store.load("questions", QUESTIONS).collect()]
        assert len(questions) == len(set(questions))
    store = MemoryStore()
    store.commit("b", {"questions": spark.createDataFrame([("q1", "?", None)], QUESTIONS)})
    store.commit("b", {"questions": spark.createDataFrame([("q1", "?", None)], QUESTIONS)})
    assert store.load("questions").count() == 1 and store.batches() == ["b"]
    store.restart()
    assert not store.batches() and not store.exists("questions")


def client(log, odd="bad"):
    """A model that fails on its first call, always on prompts that hold a word, and is slow on others."""

    def ask(prompts):
        with open(log, "a") as f:
            f.write(json.dumps(prompts) + "\n")
        with open(log) as f:
            first = len(f.readlines()) == 1
        if first or any(odd in p for p in prompts):
            raise ConnectionError("no answer")
        if any("slow" in p for p in prompts):
            time.sleep(30)
        return [f"<think>hm</think>{p.upper()}" for p in prompts]

    return ask


@pytest.mark.parametrize("kept", [True, False])
def test_model_calls(spark, tmp_path, kept):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad one"), (6, "slow one")], "id int, prompt string").coalesce(1)
    store = JsonStore(spark, str(tmp_path / "history")) if kept else None
    calls = annotate.Calls(tries=2, wait=0.01, seconds=3.0)
    df = annotate.annotated(rows, "prompt", client(log), store=store, calls=calls)
    expected = {1: "A", 2: "B", 3: "A", 4: None, 5: None, 6: None}
    assert {r.id: r.answer for r in df.collect()} == expected and df.columns == ["id", "prompt", "answer"]
    if not kept:
        return
    asked = lambda: [p for x in open(log) for p in json.loads(x)]  # noqa: E731, SIM115
    before = asked()
    assert set(before) == {"a", "b", "bad one", "slow one"}
    more = rows.unionByName(spark.createDataFrame([(7, "c")], "id int, prompt string"))
    df = annotate.annotated(more, "prompt", client(log, odd="nothing is odd now"), store=store, calls=calls)
    assert {r.id: r.answer for r in df.collect()} == expected | {5: "BAD ONE", 7: "C"}
    assert not {"a", "b"} & set(asked()[len(before) :])
    errors = {r.error for r in store.load("answers", annotate.ANSWERS).where(F.col("error").isNotNull()).collect()}
    assert any("ConnectionError" in e for e in errors) and any("Timeout" in e for e in errors)
