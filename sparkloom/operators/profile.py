"""Profiling tables into the schema layer (K1): one pass and one shuffle of (column, value) a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import FOREIGN_KEYS, PRIMARY_KEYS

SAMPLES, SAMPLE_CHARS = 5, 40
LOW, HIGH = 0.1, 0.7


def kind_of(data_type: T.DataType) -> str:
    """numeric, date, text, boolean or other, by type and not by the type's name."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "text" if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)) else "other"


def entropy_level(distinct: Column, rows: Column) -> Column:
    """low below 0.1, high above 0.7 distinct values a row, else medium; medium too where there is nothing to count."""
    ratio = distinct / F.nullif(rows, F.lit(0))
    return F.when(F.coalesce(distinct, F.lit(0)) == 0, "medium").when(ratio < LOW, "low").when(ratio > HIGH, "high").otherwise("medium")


def bounded(value: Column) -> Column:
    """A value itself up to SAMPLE_CHARS; a longer one as those of its characters and a 128-bit digest of all, so that no whole text is shuffled."""
    return F.when(F.length(value) <= SAMPLE_CHARS, value).otherwise(F.concat(F.substring(value, 1, SAMPLE_CHARS), F.lit("\u0000"), F.md5(value)))


def column_values(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, value): each distinct value of each column, nulls left out, as bounded text."""

    def pairs(table: str, df: DataFrame) -> DataFrame:
        text = lambda f: bounded(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`").cast("string")
        fields = (F.struct(F.lit(i).alias("ordinal"), text(f).alias("value")) for i, f in enumerate(df.schema))
        return df.select(F.inline(F.array(*fields))).where("value IS NOT NULL").select(F.lit(table).alias("table_name"), "ordinal", "value")

    return reduce(DataFrame.unionByName, (pairs(t, d) for t, d in frames.items())).distinct()


def schema_of(frames: dict[str, DataFrame], blocked: tuple[str, ...] = ("aid_info",), primary: dict | None = None, foreign: dict | None = None) -> DataFrame:
    """What K1 knows without reading any table: names, order, types and declared keys of all columns."""
    primary, foreign = PRIMARY_KEYS if primary is None else primary, FOREIGN_KEYS if foreign is None else foreign
    rows = [(t, i, f.name, f.dataType.simpleString(), kind_of(f.dataType), f.nullable, f.name in primary.get(t, []), (t, f.name) in foreign) for t, d in frames.items() if not any(b in t for b in blocked) for i, f in enumerate(d.schema)]
    spark = next(iter(frames.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string, kind string, nullable boolean, primary_key boolean, foreign_key boolean")


def profile_all(frames: dict[str, DataFrame], blocked: tuple[str, ...] = ("aid_info",), primary: dict | None = None, foreign: dict | None = None, columns: set[tuple[str, str]] | None = None) -> DataFrame:
    """The K1 layer: a row for each column of each table; tables whose name holds a blocked part are left out.

    primary and foreign are declared keys, those of the test tables by default. With
    ``columns`` (table, column) only those are profiled, and no other is read.
    All tables go through one distinct of (table, column, value), whose rows
    spread by value, so neither a long table nor a hot column is one task's.
    """
    use = {n: d for n, d in frames.items() if not any(b in n for b in blocked)}
    if columns is not None:
        use = {n: d.select(*(f"`{c}`" for c in d.columns if (n, c) in columns)) for n, d in use.items()}
        use = {n: d for n, d in use.items() if d.columns}
        if not use:
            return schema_of(frames, ("",)).selectExpr("table_name", "ordinal", "column_name", "data_type", "kind", "nullable", "primary_key", "foreign_key", "0L AS row_count", "0L AS n_distinct", "'medium' AS entropy_level", "CAST(array() AS array<string>) AS sample_values")
    key = ["table_name", "ordinal"]
    values = column_values(use)
    first = Window.partitionBy(*key).orderBy("value")
    samples = values.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLES)
    samples = samples.groupBy(*key).agg(F.array_sort(F.collect_list(F.substring("value", 1, SAMPLE_CHARS))).alias("sample_values"))
    counts = values.groupBy(*key).agg(F.count("*").alias("n_distinct"))
    rows = reduce(DataFrame.unionByName, (d.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, d in use.items()))
    # a row a column of the catalogue: small on every side
    out = schema_of(use, (), primary, foreign).join(rows, "table_name").join(counts, key, "left").join(samples, key, "left").withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0).cast("long")))
    level = entropy_level(F.col("n_distinct"), F.col("row_count"))
    return out.select("table_name", "ordinal", "column_name", "data_type", "kind", "nullable", "primary_key", "foreign_key", "row_count", "n_distinct", level.alias("entropy_level"), F.coalesce("sample_values", F.expr("array()").cast("array<string>")).alias("sample_values"))


def profile(df: DataFrame, table: str, primary: list[str] | None = None, foreign: list[str] | None = None) -> DataFrame:
    """K1 of one table."""
    return profile_all({table: df}, (), None if primary is None else {table: primary}, None if foreign is None else {(table, c): None for c in foreign})


def ddl(columns: DataFrame, comments: bool = False) -> DataFrame:
    """(table_name, ddl): a CREATE TABLE text for each table of K1, with samples as comments if wanted."""
    line = F.concat(F.lit("  "), "column_name", F.lit(" "), F.upper("data_type"), F.when(F.col("primary_key"), " PRIMARY KEY").otherwise(""))
    if comments:
        line = F.concat(line, F.when(F.size("sample_values") > 0, F.concat(F.lit(" -- e.g. "), F.array_join(F.slice("sample_values", 1, 3), ", "))).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"])
    return columns.groupBy("table_name").agg(lines.alias("l")).select("table_name", F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" (\n"), F.array_join("l", ",\n"), F.lit("\n);")).alias("ddl"))


DDL_LIMIT = 60_000
#: Lines that stay when a long DDL is cut down.
DDL_KEYWORDS = ("CREATE TABLE", "PRIMARY KEY", "FOREIGN KEY", "REFERENCES", "COMMENT")


def shortened(ddl_text: Column, limit: int = DDL_LIMIT) -> Column:
    """A DDL beyond the limit keeps only its lines with a keyword."""
    keep = F.filter(F.split(ddl_text, "\n"), lambda x: reduce(lambda a, b: a | b, (F.contains(F.upper(x), F.lit(k)) for k in DDL_KEYWORDS)))
    return F.when(F.length(ddl_text) > limit, F.array_join(keep, "\n")).otherwise(ddl_text)
