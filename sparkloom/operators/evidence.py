"""Evidence for errors: which knowledge layers an error calls for, and their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Layers by class of error of meaning; classes I-1 to I-4 need none.
BY_CLASS = (("II-1", "K3"), ("II-1", "K4"), ("II-2", "K6"), ("III-1", "K2"), ("III-1", "K5"), ("III-1", "K6"))
#: Layers by type of error of structure.
BY_TYPE = (("column_not_found", "K4"), ("column_semantic_mismatch", "K4"), ("join_invalid", "K6"), ("aggregation_type_mismatch", "K3"))


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("class", k, v) for k, v in BY_CLASS] + [("type", k, v) for k, v in BY_TYPE], "route string, value string, layer string")


def layers_for(errors: DataFrame) -> DataFrame:
    """(question_id, type, semantic_class, table_name, column_name, layer): a row for each layer an error calls for."""
    r = F.broadcast(routes(errors.sparkSession))
    by_class = errors.where("semantic_class IS NOT NULL").join(r.where("route = 'class'"), F.col("semantic_class") == F.col("value"))
    by_type = errors.where("semantic_class IS NULL").join(r.where("route = 'type'"), F.col("type") == F.col("value"))
    columns = ["question_id", "type", "semantic_class", "table_name", "column_name", "layer"]
    return by_class.select(columns).unionByName(by_type.select(columns)).distinct()


def retrieve(errors: DataFrame, k2: DataFrame, k3: DataFrame, k4: DataFrame, k5: DataFrame, k6: DataFrame) -> DataFrame:
    """(question_id, layer, item): the rows of knowledge that the errors call for, as text."""
    need = layers_for(errors)
    of = lambda layer: need.where(F.col("layer") == layer).select("question_id", "layer", F.col("table_name").alias("t"), F.col("column_name").alias("c"))
    # an error without a table meets every row: such rows stand under one more key
    everything = F.lit("*")
    k5 = k5.select("table_name", "description", F.explode(F.array("table_name", everything)).alias("key"))
    k6 = k6.select("source_table", "source_column", "target_table", "target_column", F.explode(F.array_distinct(F.array("source_table", "target_table", everything))).alias("key"))
    keyed = lambda layer: of(layer).withColumn("key", F.coalesce("t", everything))
    parts = [
        of("K2").select("question_id", "layer").distinct().join(F.broadcast(k2.limit(1)), F.lit(True)).select("question_id", "layer", F.col("description").alias("item")),
        # an error with a table looks its columns up; one without names no rows
        of("K3").join(k3, (F.col("t") == F.col("table_name"))).select("question_id", "layer", F.format_string("%s.%s: %s", "table_name", "column_name", "category").alias("item")),
        of("K4").join(k4, (F.col("t") == F.col("table_name"))).select("question_id", "layer", F.format_string("%s.%s: %s", "table_name", "column_name", "description").alias("item")),
        keyed("K5").join(k5, "key").select("question_id", "layer", F.format_string("%s: %s", "table_name", "description").alias("item")),
        keyed("K6").join(k6, "key").select("question_id", "layer", F.format_string("%s.%s -> %s.%s", "source_table", "source_column", "target_table", "target_column").alias("item")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def is_empty(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """questions without any evidence."""
    return questions.join(evidence.select("question_id"), "question_id", "left_anti")


def rendered(items: DataFrame, text: str = "item", order: tuple[str, ...] = ("layer", "item")) -> DataFrame:
    """(question_id, block): numbered lines of each question's items."""
    w = Window.partitionBy("question_id").orderBy(*order)
    lines = items.withColumn("n", F.row_number().over(w)).select("question_id", F.struct("n", F.concat(F.col("n").cast("string"), F.lit(". "), F.col(text)).alias("l")).alias("x"))
    return lines.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n").alias("block"))
