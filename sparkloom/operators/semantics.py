"""Field categories (K3) and table meaning (K5) by rules, and the summaries built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The categories of a field.
CATEGORIES = ("identifier", "measure", "dimension", "datetime", "text", "boolean", "other")


#: Names of identifiers: key or id as a word of its own, or key after a prefix of the table's letter and one word (``o_custkey``); ``monkey`` is none.
IDENTIFIER = "(^|_)(key|id)$|^[a-z]{1,2}_[a-z]*key$"


def category() -> Column:
    """A column's category from its row in K1; the first rule that fits."""
    name = F.lower("column_name")
    return (
        F.when(F.col("primary_key") | F.col("foreign_key") | name.rlike(IDENTIFIER) | F.col("column_name").rlike("[a-z0-9](Key|Id|ID)$"), "identifier")
        .when(F.col("kind") == "date", "datetime")
        .when((F.col("kind") == "boolean") | ((F.col("n_distinct") == 2) & name.rlike("flag|status|is_|has_|yn$")), "boolean")
        .when(F.col("kind") == "numeric", "measure")
        .when((F.col("kind") == "text") & (F.col("entropy_level") == "low"), "dimension")
        .when(F.col("kind") == "text", "text")
        .otherwise("other")
    )


def classify(columns: DataFrame) -> DataFrame:
    """K3: (table_name, column_name, category, confidence, data_type)."""
    return columns.select("table_name", "column_name", category().alias("category"), F.lit(0.8).alias("confidence"), "data_type")


def category_distribution(k3: DataFrame) -> DataFrame:
    """Per table and category: n, percentage of the table's columns, the first three columns by name."""
    n = k3.groupBy("table_name", "category").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("column_name")), 1, 3).alias("examples"))
    total = F.sum("n").over(Window.partitionBy("table_name"))
    return n.select("table_name", "category", "n", F.round(F.col("n") / total * 100, 1).alias("percentage"), "examples")


def entropy_distribution(columns: DataFrame) -> DataFrame:
    """Per table: how many columns are of each entropy level, and percentages; unknown levels count as medium."""
    level = F.when(F.col("entropy_level").isin("low", "high"), F.col("entropy_level")).otherwise("medium")
    n = lambda x: F.count(F.when(level == x, 1))
    counts = columns.groupBy("table_name").agg(n("low").alias("low"), n("medium").alias("medium"), n("high").alias("high"), F.count("*").alias("n"))
    return counts.select("table_name", "low", "medium", "high", *(F.round(F.col(x) / F.col("n") * 100, 1).alias(f"{x}_pct") for x in ("low", "medium", "high")))


def guidance(distribution: DataFrame) -> DataFrame:
    """What a table's entropy says of it; the first share that is passed."""
    text = F.when(F.col("low_pct") > 60, "mostly_categorical").when(F.col("high_pct") > 40, "mostly_unique").when(F.col("medium_pct") > 50, "mostly_varied").otherwise("mixed")
    return distribution.select("table_name", text.alias("guidance"))


def patterns(k3: DataFrame) -> DataFrame:
    """Per table: business pattern and type, by counts of categories; the order of rules matters."""
    n = lambda x: F.count(F.when(F.col("category") == x, 1))
    c = k3.groupBy("table_name").agg(n("identifier").alias("ident"), n("measure").alias("measure"), n("dimension").alias("dim"))
    pattern = F.when((F.col("dim") >= 3) & (F.col("ident") == 0), "dictionary").when(F.col("ident") >= 2, "master").when((F.col("measure") > 0) & (F.col("dim") >= 3), "fact").when(F.col("dim") >= 3, "dimension").otherwise("generic")
    c = c.select("table_name", pattern.alias("pattern"))
    kind = F.when(F.col("pattern") == "dictionary", "config").when(F.col("pattern") == "master", "entity").when(F.col("pattern") == "dimension", "dimension").otherwise("data_table")
    return c.withColumn("business_type", kind)


def representative_samples(columns: DataFrame) -> DataFrame:
    """Per column: the first three samples, cut to 17 characters and dots beyond 20."""
    cut = F.transform(F.slice("sample_values", 1, 3), lambda v: F.when(F.length(v) > 20, F.concat(F.substring(v, 1, 17), F.lit("..."))).otherwise(v))
    return columns.select("table_name", "column_name", F.array_join(cut, ", ").alias("samples"))


def key_columns(columns: DataFrame) -> DataFrame:
    """Per table: primary and foreign key counts, and the primary key's columns in order."""
    keys = F.transform(F.array_sort(F.collect_list(F.when(F.col("primary_key"), F.struct("ordinal", "column_name")))), lambda x: x["column_name"])
    return columns.groupBy("table_name").agg(F.sum(F.col("primary_key").cast("long")).alias("pk_count"), F.sum(F.col("foreign_key").cast("long")).alias("fk_count"), keys.alias("key_columns"))


def importance(columns: DataFrame) -> DataFrame:
    """high for keys, medium for measures and dimensions, else low."""
    level = F.when(F.col("primary_key") | F.col("foreign_key"), "high").when(F.col("category").isin("measure", "dimension"), "medium").otherwise("low")
    return columns.withColumn("category", category()).select("table_name", "column_name", level.alias("importance"), F.col("category").isin("measure", "dimension").alias("measure_or_dimension"))


def domain_confidence(*parts: Column) -> Column:
    """Completeness of five parts, 0.2 each, times 1.2, at most 1."""
    filled = reduce(lambda a, b: a + b, (F.when(p.isNotNull() & (F.length(p.cast("string")) > 0), 0.2).otherwise(0.0) for p in parts))
    return F.least(F.lit(1.0), filled * 1.2)


def layer_summary(**layers: DataFrame) -> DataFrame:
    """(layer, n): rows of each knowledge layer."""
    return reduce(DataFrame.unionByName, (d.agg(F.count("*").alias("n")).select(F.lit(name).alias("layer"), "n") for name, d in layers.items()))
