"""The corpus pipeline: each stage on its input, and all of them."""

import collections
import re

import corpus_pipeline
import pytest

from sparkloom.llm import mixing, queries


def test_stages(spark, folder):
    docs = queries.table(spark, folder, "documents")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder)
        assert docs.schema.simpleString() == before.schema.simpleString(), name
        docs = docs.cache()
        seen.append(docs.count())
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()} and len(ids) == seen[-1]
        if name == "substring_dedup":
            assert docs.where("n_chars <> char_length(text)").count() == 0
    assert seen[0] >= seen[1] > seen[2] == seen[3] > seen[4] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids


def test_run_is_the_stages(spark, folder):
    a, b = (corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32") for _ in range(2))
    rows = a.collect()
    assert rows and sorted(map(tuple, rows)) and {r.doc_id for r in rows} == {r.doc_id for r in b.collect()}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_give_rows(name, spark, folder):
    assert queries.queries()[name](spark, folder).count() > 0


def test_mixing_counts_all_words(spark, folder, monkeypatch):
    docs = queries.table(spark, folder, "documents")
    seen, described = [], mixing.described
    monkeypatch.setattr(mixing, "described", lambda df, names, *rest: seen.append(names) or described(df, names, *rest))
    corpus_pipeline.mix_sources(spark, docs, folder)
    texts = [r.text or "" for r in docs.select("text").collect()]
    held = collections.Counter(w for t in texts for w in {w for w in re.split(r"[\W_]+", t.lower()) if len(w) >= mixing.TOPIC_LETTERS})
    expected = sorted((-n, w) for w, n in held.items() if n <= mixing.TOPIC_MOST * len(texts))
    assert seen == [[w for _, w in expected[: mixing.TOPICS]]]
