"""SQLite files as a Spark data source, read in ranges of row numbers.

The file must be at the same path on all machines that read it. Declared types
are mapped by SQLite's rules of affinity; a stored value that doesn't fit its
column's type becomes null.

Columns are read that are asked for (option columns), and conditions asked for (option
where: comparisons with constants) go into SQLite's statement. Where a stored value is of
another class than its column's type, SQLite would compare it otherwise than Spark, so
such rows are sent whatever they hold, and Spark looks at all that comes once more. The
session's own pushing of filters into Python sources isn't used: it keeps what one query
pushed for the next query of the same DataFrame.
"""

from __future__ import annotations

import json
import math
import sqlite3
import operator
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def kind_of(declared: str) -> str:
    """Spark's type for a declared type, by affinity."""
    d = (declared or "").upper()
    if "BOOL" in d:
        return "boolean"
    if "INT" in d and "POINT" not in d and "INTERVAL" not in d:
        return "bigint"
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return "double"
    return "binary" if "BLOB" in d else "string"


def _fitting(value, kind: str):
    try:
        if value is None:
            return None
        if kind == "bigint":
            return int(value) if not isinstance(value, bytes) and float(value) == int(float(value)) else None
        if kind == "double":
            return float(value)
        if kind == "boolean":
            return bool(value)
        if kind == "binary":
            return value if isinstance(value, bytes) else str(value).encode()
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    except (TypeError, ValueError, OverflowError):
        return None


#: Storage classes whose values are compared in SQLite as Spark compares them, by Spark's type.
PLAIN = {"bigint": "('integer')", "double": "('integer', 'real')", "string": "('text')"}
#: Comparisons that may be asked for, besides "in", "is null" and "is not null".
COMPARED = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
#: (column, comparison, constant); a list of them for "in", None for the tests for null.
Condition = tuple[str, str, object]


def _constant(value: object, kind: str) -> str | None:
    """A constant of a column's type in SQLite's terms; None where it can't be written exactly."""
    if kind == "string" and isinstance(value, str) and "\0" not in value:
        return "'" + value.replace("'", "''") + "'"
    if kind == "bigint" and isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 63:
        return str(value)
    if kind == "double" and isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value):
        return repr(float(value))
    return None


def pushed(c: Condition, columns: dict[str, str]) -> str | None:
    """A condition in SQLite's terms that holds for each row for which it holds in Spark, and perhaps for more; None if there is none."""
    column, comparison, value = c
    if columns.get(column) not in PLAIN:
        return None
    kind, name = columns[column], _quoted(column)
    other = f"typeof({name}) NOT IN {PLAIN[kind]}"
    if comparison == "is null":
        return other
    if comparison == "is not null":
        return f"{name} IS NOT NULL"
    values = [_constant(v, kind) for v in (value if comparison == "in" else (value,))]
    if not values or None in values:
        return None
    test = f"IN ({', '.join(values)})" if comparison == "in" else f"{comparison} {values[0]}"
    return f"({name} COLLATE BINARY {test} OR ({other} AND {name} IS NOT NULL))"


def holds(c: Condition) -> Column:
    """A condition in Spark's terms."""
    column, comparison, value = F.col(f"`{c[0]}`"), c[1], c[2]
    if comparison in ("is null", "is not null"):
        return column.isNull() if comparison == "is null" else column.isNotNull()
    if comparison == "in":
        return column.isin(list(value))
    if comparison not in COMPARED:
        raise ValueError(f"{comparison} is no comparison")
    return COMPARED[comparison](column, F.lit(value))


class Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, partitions: int, columns: list[tuple[str, str]], conditions: list[str] | None = None):
        self.path, self.table, self.parts, self.columns, self.conditions = path, table, partitions, columns, conditions or []

    def statement(self, partition: Range) -> str:
        """What is sent to SQLite for a partition."""
        names = ", ".join(_quoted(n) for n, _ in self.columns)
        where = [*([] if partition.low is None else [f"rowid BETWEEN {partition.low} AND {partition.high}"]), *self.conditions]
        return f"SELECT {names} FROM {_quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")

    def partitions(self) -> list[Range]:
        with _open(self.path) as c:
            try:
                low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a view or a table without row numbers
                return [Range(None, None)]
        if low is None:
            return [Range(1, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        with _open(self.path) as c:
            c.text_factory = bytes
            for row in c.execute(self.statement(partition)):
                yield tuple(_fitting(v, k) for v, (_, k) in zip(row, self.columns, strict=True))


class SqliteSource(DataSource):
    """format("sqlite3") with options path, table, partitions, columns and where (JSON lists)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite3"

    def _every(self) -> dict[str, str]:
        with _open(self.options["path"]) as c:
            found = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return {r[1]: kind_of(r[2]) for r in found}

    def _columns(self) -> list[tuple[str, str]]:
        every = self._every()
        wanted = json.loads(self.options["columns"]) if "columns" in self.options else list(every)
        if lost := [n for n in wanted if n not in every]:
            raise ValueError(f"{self.options['table']} has no column {', '.join(lost)}")
        return [(n, every[n]) for n in wanted]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {k}" for n, k in self._columns())

    def reader(self, schema: StructType) -> SqliteReader:
        every = self._every()
        conditions = [x for c in json.loads(self.options.get("where", "[]")) if (x := pushed(tuple(c), every))]
        return SqliteReader(self.options["path"], self.options["table"], int(self.options.get("partitions", "4")), self._columns(), conditions)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 4, columns: list[str] | None = None, where: list[Condition] | None = None) -> DataFrame:
    """A table, or some of its columns, or the rows for which all conditions hold; SQLite sends no others (but for odd values, see above)."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite3").option("path", path).option("table", table).option("partitions", str(partitions))
    wanted = None if columns is None else [*columns, *(c[0] for c in where or () if c[0] not in columns)]
    reader = reader if wanted is None else reader.option("columns", json.dumps(wanted))
    if not where:
        return reader.load()
    rows = reader.option("where", json.dumps(where)).load().where(reduce(operator.and_, map(holds, where)))
    return rows if columns is None else rows.select(*(f"`{c}`" for c in columns))


def keys_of(path: str) -> tuple[list[str], dict[str, list[str]], dict[tuple[str, str], tuple[str, str]]]:
    """Tables, their primary keys, and declared foreign keys of a file."""
    primary, foreign = {}, {}
    with _open(path) as c:
        tables = [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        for t in tables:
            info = c.execute(f"PRAGMA table_info({_quoted(t)})").fetchall()
            primary[t] = [r[1] for r in sorted((r for r in info if r[5]), key=lambda r: r[5])]
        for t in tables:
            for r in c.execute(f"PRAGMA foreign_key_list({_quoted(t)})"):
                target = r[4] or (primary.get(r[2]) or [None])[0]
                if target:
                    foreign[t, r[3]] = (r[2], target)
    return tables, primary, foreign
