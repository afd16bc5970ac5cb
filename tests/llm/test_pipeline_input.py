"""Pipeline stages on odd input: nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names; each against brute force."""

import hashlib
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import brute_components, brute_dedup, vocabulary

from sparkloom.llm import mixing, packing, queries, toxicity

CLASH = "score string, kept string, topic string, n_tokens string, probability string, id string, crc string, at string, c0 string, c1 string, spans string, n_words string, _lang string, _source string, _topic string, node string, text_hash string, `a.b` string"


def made(spark, rows):
    names = [c.replace("`", "").strip().rsplit(" ", 1) for c in CLASH.split(",")]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + CLASH
    return spark.createDataFrame([(d, t, lang, source, None if t is None else len(t), *(None if i % 5 == 0 else f"{n[0]}{i}" for n in names)) for i, (d, t, lang, source) in enumerate(rows)], schema)


@pytest.fixture(scope="module")
def rows():
    rng, vocab = random.Random(11), vocabulary(900, 5)
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = prose(60)
    out = [(i, prose(rng.randint(1, 150)) + (" grolk vashtir" * 3 if i % 4 == 0 else ""), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None])) for i in range(160)]
    out += [(200 + i, f"{prose(20)} {passage} {prose(i)}", "en", "a") for i in range(8)]
    out += [(300 + i, out[1][1], "en", "b") for i in range(4)] + [(310, out[2][1] + " more", "en", "b")]
    out += [(400, None, None, None), (401, "", "en", "a"), (402, " \n\t ", "en", "a"), (403, prose(15_000), "de", "b"), (None, prose(40), "en", "a"), (None, None, None, None), (None, passage, "en", "a")]
    return [*out, out[5], out[5], out[161]]


@pytest.fixture(scope="module")
def folder_of_labels(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    labels = [(d, 1, int(d % 4 == 0)) for d, *_ in rows if d is not None and d < 160] + [(None, 1, 1), (400, None, None), (999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


def test_stages_keep_columns_and_agree_with_brute_force(spark, rows, folder_of_labels):
    docs = made(spark, rows)
    every = {name: stage(spark, docs, folder_of_labels) for name, stage in corpus_pipeline.STAGES}
    for name, df in list(every.items())[:-1]:
        assert df.schema.simpleString() == docs.schema.simpleString(), name
    whole = [tuple(r) for r in docs.collect()]
    found = {name: [tuple(r) for r in df.collect()] for name, df in every.items()}

    net = toxicity.train(docs, queries.table(spark, folder_of_labels, "labels"))
    import pyarrow as pa

    scores = toxicity.score_texts(net, pa.array([r[1] for r in whole], pa.string()))
    assert same(found["toxicity"], [r for r, s in zip(whole, scores, strict=True) if s < 0.5])

    kept = {d: c for d, _, c in brute_components([r[:2] for r in whole], 5, 80)}
    want = [r for r in whole if r[0] is None or kept[r[0]] == r[0]]
    got = found["ngram_jaccard_join"]
    assert {r[0] for r in got} == {r[0] for r in want} and sum(r[0] is None for r in got) == 3
    assert all(r in whole for r in got) and len({r[:2] for r in got if r[0] is not None}) == sum(r[0] is not None for r in got)

    cut = sorted(((r[0], hashlib.sha256(b" ".join((r[1] or "").encode().split())).hexdigest()) for r in found["substring_dedup"]), key=repr)
    assert cut == sorted(((d, h) for d, _, _, h in brute_dedup([r[:2] for r in whole], 50)), key=repr)
    assert all(r[4] == len(r[1]) for r in found["substring_dedup"]) and same([r[5:] for r in found["substring_dedup"]], [r[5:] for r in whole])

    mixed = mixing.mix(docs)
    assert same(found["mixing"], [tuple(r)[: len(docs.columns)] for r in mixed.collect() if r[mixing.added(docs)[-1]]])

    pieces = every["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"))
    encoder = packing.Encoder(queries.tokenizer_path())
    tokens = {}
    for r in whole:
        tokens[r[0]] = tokens.get(r[0], 0) + len(encoder.encode([r[1] or ""])[0]) // 4
    assert {r.doc_id: r.n for r in pieces.collect()} == tokens


def test_stages_of_empty_tables(spark, rows, folder_of_labels):
    docs = made(spark, rows).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder_of_labels).count() == 0, name


def test_run_over_odd_input(spark, rows, folder_of_labels):
    docs = made(spark, rows)
    docs.write.mode("overwrite").parquet(f"{folder_of_labels}/documents.parquet")
    pieces = corpus_pipeline.run(spark, folder_of_labels)
    step = spark.read.parquet(f"{folder_of_labels}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, folder_of_labels).cache()
    want = corpus_pipeline.STAGES[-1][1](spark, step, folder_of_labels)
    mark = lambda df: sorted(map(repr, df.groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("c")).select("doc_id", "n").collect()))
    assert mark(pieces) == mark(want) and pieces.count() > 0
