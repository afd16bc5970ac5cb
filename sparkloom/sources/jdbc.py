"""Tables of a database by JDBC, read in partitions of about as many rows each.

Equal ranges of a key, as ``lowerBound`` and ``upperBound`` give, are uneven as soon as
keys are. Here the database counts its rows by ranges of the key, and ranges that hold
too many are cut again, so that limits follow the rows: a histogram made of sums that any
SQL database knows. Filters and columns of the query are pushed by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Ranges that a range is cut into, and sums in one statement.
CUTS, SUMS = 16, 256


def _quoted(spark: SparkSession, url: str, name: str) -> str:
    """A column's name as the database quotes it."""
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(name)


def _counts(spark: SparkSession, url: str, table: str, key: str, ranges: list[tuple[int, int]], **options: str) -> list[int]:
    """Rows with keys from low to high, for each range."""
    found: list[int] = []
    for i in range(0, len(ranges), SUMS):
        part = ranges[i : i + SUMS]
        sums = ", ".join(f"SUM(CASE WHEN {key} BETWEEN {a} AND {b} THEN 1 ELSE 0 END) AS c{n}" for n, (a, b) in enumerate(part))
        row = spark.read.format("jdbc").options(url=url, dbtable=f"(SELECT {sums} FROM {table} t) s", **options).load().first()
        found += [int(x or 0) for x in row]
    return found


def key_ranges(spark: SparkSession, url: str, table: str, key: str, partitions: int, **options: str) -> list[tuple[int, int, int]]:
    """(low, high, rows): ranges of a whole-number key, in order, each with about a partition's share of the rows or one key alone."""
    name, key = key, _quoted(spark, url, key)
    ends = spark.read.format("jdbc").options(url=url, dbtable=f"(SELECT MIN({key}) AS low, MAX({key}) AS high, COUNT({key}) AS n FROM {table} t) s", **options).load().first()
    low, high, rows = ends[0], ends[1], int(ends[2])
    if not rows:
        return []
    if int(low) != low or int(high) != high:
        raise ValueError(f"{name} is no whole number")
    share = -(-rows // partitions)
    known = [(int(low), int(high), rows)]
    while wide := [r for r in known if r[2] > max(1, share // 4) and r[1] > r[0]]:
        cut = []
        for a, b, _ in wide:
            step = -(-(b - a + 1) // CUTS)
            cut += [(x, min(b, x + step - 1)) for x in range(a, b + 1, step)]
        counted = zip(cut, _counts(spark, url, table, key, cut, **options), strict=True)
        known = sorted([r for r in known if r not in wide] + [(a, b, n) for (a, b), n in counted if n])
    out: list[tuple[int, int, int]] = []
    for a, b, n in known:
        if out and out[-1][2] + n <= share:
            out[-1] = out[-1][0], b, out[-1][2] + n
        else:
            out.append((a, b, n))
    return out


def jdbc_by_key(spark: SparkSession, url: str, table: str, key: str, partitions: int = 16, **options: str) -> DataFrame:
    """A table in partitions by ranges of a whole-number key; rows without a key are a partition by themselves.

    Rows whose keys lie between or beyond the ranges counted (written meanwhile) belong
    to a neighbouring range, so none is lost.
    """
    found, key = key_ranges(spark, url, table, key, partitions, **options), _quoted(spark, url, key)
    limits = [a for a, _, _ in found[1:]]
    predicates = [f"{key} IS NULL"]
    for a, b in zip([None, *limits], [*limits, None], strict=True):
        parts = [*([] if a is None else [f"{key} >= {a}"]), *([] if b is None else [f"{key} < {b}"])]
        predicates.append(" AND ".join(parts) or f"{key} IS NOT NULL")
    return spark.read.jdbc(url, table, predicates=predicates, properties=options)
