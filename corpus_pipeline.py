"""A corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's docs. All but the last return
the columns of documents, whatever further columns those have: what a stage works
with takes a name that is free. Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import jaccard, mixing, packing, queries, substrings, toxicity
from sparkloom.llm.shared import removed, shared_folder, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores 0.5 or more go. A null or empty text scores lowest; without labels of both kinds all stay."""
    score = unused("score", *docs.columns)
    net = toxicity.train(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, net, name=score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the one with the smallest id stays.

    Documents without words are linked with nothing; rows with a null id stay; of rows with equal id and text one stays.
    """
    return jaccard.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document holds are cut out; every document stays a row.

    A text without repeats stays as it is (a null text becomes an empty one); rows with a null id are kept whole; n_chars counts what is left.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    numbered = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))
    kept = substrings.dedup(numbered, carry=tuple(numbered.columns[2:]), texts_too=True)
    kept = kept.select("doc_id", F.col("kept").alias("text"), *(F.col(f"c{i}").alias(c) for i, c in enumerate(others)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*(f"`{c}`" for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics meet the target weights. Nulls in source or language are a value of their own."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: a row for each piece. A null or empty text is its end id alone; rows of one id are packed each."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_duplicates), ("substring_dedup", cut_repeats), ("mixing", mix_sources), ("packing", pack)]

#: Neither the network's scores nor the tokenizer can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder, and a stage's input goes when its result is written."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                removed(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
