"""A set of tables with their declared keys, wherever they come from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as parquet
from .sqlite import keys_of, read_sqlite


def declared(columns: DataFrame, keys: DataFrame) -> tuple[dict[str, list[str]], dict[str, list[str]], dict[tuple[str, str], tuple[str, str]]]:
    """(columns by table, in their order; primary keys by table; foreign keys) from the rows of INFORMATION_SCHEMA's COLUMNS and KEY_COLUMN_USAGE.

    What reaches the driver is one row for each column of the schema; no table or column is capped.
    """
    names: dict[str, list[str]] = {}
    for r in columns.select("TABLE_NAME", "COLUMN_NAME", "ORDINAL_POSITION").orderBy("TABLE_NAME", "ORDINAL_POSITION").collect():
        names.setdefault(r[0], []).append(r[1])
    primary: dict[str, list[str]] = {}
    foreign: dict[tuple[str, str], tuple[str, str]] = {}
    for r in keys.select("TABLE_NAME", "COLUMN_NAME", "CONSTRAINT_NAME", "REFERENCED_TABLE_NAME", "REFERENCED_COLUMN_NAME", "ORDINAL_POSITION").orderBy("TABLE_NAME", "ORDINAL_POSITION").collect():
        if r["REFERENCED_TABLE_NAME"] is not None:
            foreign[r[0], r[1]] = r["REFERENCED_TABLE_NAME"], r["REFERENCED_COLUMN_NAME"]
        elif r["CONSTRAINT_NAME"] == "PRIMARY":
            primary.setdefault(r[0], []).append(r[1])
    return names, primary, foreign


@dataclass
class Catalog:
    name: str
    frames: dict[str, DataFrame]
    primary: dict[str, list[str]] = field(default_factory=dict)
    foreign: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)

    def register(self) -> None:
        """Make the tables views of the session, as generated SQL names them."""
        for name, df in self.frames.items():
            df.createOrReplaceTempView(name)

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, names: tuple[str, ...], name: str = "warehouse") -> Catalog:
        t = parquet.Tables(spark, folder)
        return cls(name, {n: getattr(t, n) for n in names}, {k: v for k, v in parquet.PRIMARY_KEYS.items() if k in names}, {k: v for k, v in parquet.FOREIGN_KEYS.items() if k[0] in names and v[0] in names})

    @classmethod
    def of_mysql(cls, spark: SparkSession, url: str, schema: str, **options: str) -> Catalog:
        """A MySQL schema by JDBC: all its tables, with the keys that its information schema declares."""
        read = lambda table: parquet.jdbc(spark, url, f"INFORMATION_SCHEMA.{table}", **options).where(F.col("TABLE_SCHEMA") == schema)
        names, primary, foreign = declared(read("COLUMNS"), read("KEY_COLUMN_USAGE"))
        return cls(schema, {n: parquet.jdbc(spark, url, f"`{schema}`.`{n}`", **options).select(*columns) for n, columns in names.items()}, primary, foreign)

    @classmethod
    def of_sqlite(cls, spark: SparkSession, path: str, partitions: int = 4) -> Catalog:
        names, primary, foreign = keys_of(path)
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        return cls(stem, {n: read_sqlite(spark, path, n, partitions) for n in names}, primary, foreign)
