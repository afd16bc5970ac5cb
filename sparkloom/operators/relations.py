"""Relations between tables (K6): declared keys, names, and inclusion of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import FOREIGN_KEYS

SCHEMA = "source_table string, source_column string, target_table string, target_column string, relationship_type string, confidence double, reason string"


def stem(column: Column) -> Column:
    """The table a column name points to: what stands before ``_id``, or before ``id`` or ``key`` after a first letter prefix; null if nothing does."""
    name = F.lower(column)
    return F.when(name.rlike(".+_id$"), F.regexp_extract(name, "^(.+)_id$", 1)).when(name.rlike("^[a-z]{1,2}_.+key$"), F.regexp_extract(name, "^[a-z]{1,2}_(.+)key$", 1)).when(column.rlike(".+I[dD]$"), F.regexp_extract(name, "^(.+)id$", 1))


def variants(tables: DataFrame) -> DataFrame:
    """(variant, target_table): forms of a table name that a stem may take: itself, with s, without, and its short form in keys."""
    t = F.lower("table_name")
    forms = F.array_distinct(F.array(t, F.concat(t, F.lit("s")), F.regexp_replace(t, "s+$", ""), F.substring(t, 1, 4)))
    return tables.select("table_name").distinct().select(F.explode(forms).alias("variant"), F.col("table_name").alias("target_table"))


def declared(columns: DataFrame, foreign: dict | None = None) -> DataFrame:
    """Declared foreign keys of the tables in K1."""
    spark = columns.sparkSession
    rows = [(s, c, t, k, "many_to_one", 0.9, "declared foreign key") for (s, c), (t, k) in (FOREIGN_KEYS if foreign is None else foreign).items()]
    known = spark.createDataFrame(rows, SCHEMA)
    there = columns.select("table_name").distinct()
    return known.join(F.broadcast(there.withColumnRenamed("table_name", "source_table")), "source_table", "left_semi").join(F.broadcast(there.withColumnRenamed("table_name", "target_table")), "target_table", "left_semi").select(*known.columns)


def by_name(columns: DataFrame) -> DataFrame:
    """Relations inferred from names: a column's stem names another table, whose own key is the target; not a table to itself."""
    pointing = columns.where("NOT primary_key OR foreign_key").select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), stem(F.col("column_name")).alias("variant")).where("variant IS NOT NULL")
    keys = columns.where("primary_key").groupBy(F.col("table_name").alias("target_table")).agg(F.min("column_name").alias("target_column"), F.count("*").alias("n")).where("n = 1").drop("n")
    found = pointing.join(variants(columns), "variant").where("source_table <> target_table").join(keys, "target_table")
    return found.select("source_table", "source_column", "target_table", "target_column", F.lit("many_to_one").alias("relationship_type"), F.lit(0.6).alias("confidence"), F.lit("inferred from the column's name").alias("reason")).distinct()


def merged(*parts: DataFrame) -> DataFrame:
    """All relations, the most confident one for each pair of columns."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    w = Window.partitionBy("source_table", "source_column", "target_table", "target_column").orderBy(F.desc("confidence"), "reason")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def relation_type(text: Column) -> Column:
    """A stated relation type in one of four forms; many_to_one if it says nothing known."""
    x = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\s_-]+", ""))
    return F.when(x.rlike("m:n|n:m|manytomany"), "many_to_many").when(x.rlike("1:1|onetoone"), "one_to_one").when(x.rlike("1:n|1:m|onetomany"), "one_to_many").otherwise("many_to_one")


def included(source: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """(orphans, unique): values of column that target lacks, and whether key is unique; one row.

    A relation by inclusion also needs names that match: small whole numbers are
    included in each other by chance.
    """
    values = source.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct()
    orphans = values.join(target.select(F.col(key).alias("v")), "v", "left_anti").agg(F.count("*").alias("orphans"))
    unique = target.agg((F.count(key) == F.count_distinct(key)).alias("unique"))
    return orphans.crossJoin(unique)


def from_entities(relations: DataFrame, tables: DataFrame) -> DataFrame:
    """Relations of a conceptual model, (source_entity, target_entity, kind), mapped to tables by name variants; columns stay null and such rows never decide a join check."""
    v = variants(tables)
    s, t = v.toDF("sv", "source_table"), v.toDF("tv", "target_table")
    rows = relations.join(s, F.lower("source_entity") == F.col("sv")).join(t, F.lower("target_entity") == F.col("tv"))
    none = F.lit(None).cast("string")
    return rows.select("source_table", none.alias("source_column"), "target_table", none.alias("target_column"), relation_type(F.col("kind")).alias("relationship_type"), F.lit(0.7).alias("confidence"), F.lit("conceptual relation").alias("reason")).dropDuplicates(["source_table", "target_table"])


def proposed_model(columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A conceptual model by rules, for want of a language model: (entities, relations) in the form that :func:`valid_model` takes.

    Each table with a key is an entity with that key as attribute; each declared or inferred key is a relation.
    """
    entity = lambda c: F.initcap(F.regexp_replace(c, "_", " "))
    entities = columns.where("primary_key").select(entity("table_name").alias("entity"), "table_name", "column_name")
    found = merged(declared(columns), by_name(columns)).select(entity("source_table").alias("source_entity"), entity("target_table").alias("target_entity"), F.lit("N:1").alias("kind"))
    return entities, found.distinct()


def split(k6: DataFrame) -> DataFrame:
    """k6 with part: ``conceptual`` for relations of the conceptual model (no columns), else ``logical``; every relation has one part."""
    return k6.withColumn("part", F.when(F.col("source_column").isNull(), "conceptual").otherwise("logical"))


def valid_model(entities: DataFrame, relations: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (entity, table_name, column_name) with an attribute that exists, and relations with both ends kept."""
    kept = entities.join(columns.select("table_name", "column_name"), ["table_name", "column_name"], "left_semi")
    names = kept.select("entity").distinct()
    relations = relations.join(names.withColumnRenamed("entity", "source_entity"), "source_entity", "left_semi")
    return kept, relations.join(names.withColumnRenamed("entity", "target_entity"), "target_entity", "left_semi")


def foreign_keys(k6: DataFrame) -> DataFrame:
    return k6.where(F.col("relationship_type").isin("many_to_one", "one_to_many"))


def involving(k6: DataFrame, table: str) -> DataFrame:
    return k6.where((F.col("source_table") == table) | (F.col("target_table") == table))
