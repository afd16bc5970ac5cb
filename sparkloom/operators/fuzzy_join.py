"""Fuzzy joins of two large sides: a text holds a keyword anywhere, found by an index of q-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 3


def grams(text: Column, q: int) -> Column:
    """The different runs of q characters of a text."""
    n = F.char_length(text)
    at = F.when(n >= q, F.sequence(F.lit(1), n - (q - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(q))))


def contains_join(texts: DataFrame, keywords: DataFrame, text: str, keyword: str, q: int = Q) -> DataFrame:
    """Rows of texts with each row of keywords whose keyword stands in the text, as ``text LIKE '%keyword%'`` has it.

    A keyword is filed under the one of its q-grams that fewest texts hold; keywords with
    a gram that no text holds go before the texts are joined. A text asks for all its
    grams, and what meets is held against the text. Keywords shorter than q are grams
    themselves and meet equal ones. So both sides are dealt by gram, and none is compared
    whole; equal texts and equal keywords are indexed once. Nulls meet nothing, an empty
    keyword every text; ``%`` and ``_`` in a keyword are plain characters. The sides have
    no column name in common.
    """
    t, k = F.col("_text"), F.col("_keyword")
    values = texts.select(F.col(text).alias("_text")).where("_text IS NOT NULL").distinct()
    words = keywords.select(F.col(keyword).alias("_keyword")).where("_keyword IS NOT NULL").distinct()
    asked = values.select("_text", F.explode(grams(t, q)).alias("_gram"))
    held = asked.groupBy("_gram").agg(F.count("*").alias("_held"))
    long_words = words.where(F.char_length(k) >= q).withColumn("_grams", grams(k, q))
    met = long_words.select("_keyword", F.size("_grams").alias("_n"), F.explode("_grams").alias("_gram")).join(held, "_gram")
    filed = met.groupBy("_keyword", "_n").agg(F.count("*").alias("_found"), F.min(F.struct("_held", "_gram")).alias("_least")).where("_found = _n")
    pairs = [asked.join(filed.select("_keyword", F.col("_least._gram").alias("_gram")), "_gram").where(F.contains(t, k)).select("_text", "_keyword")]
    for n in range(1, q):
        short = words.where(F.char_length(k) == n)
        pairs.append(values.select("_text", F.explode(grams(t, n)).alias("_keyword")).join(short, "_keyword").select("_text", "_keyword"))
    if not words.where("_keyword = ''").isEmpty():
        pairs.append(values.select("_text", F.lit("").alias("_keyword")))
    found = reduce(DataFrame.unionByName, pairs)
    rows = texts.join(found, F.col(text) == t).drop("_text")
    return rows.join(keywords, k == F.col(keyword)).drop("_keyword")
