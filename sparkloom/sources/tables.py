"""Tables of a data folder, as DataFrames and as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Declared keys: Parquet files carry none. Primary keys by table; foreign keys (table, column) -> (table, column).
PRIMARY_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"]}
FOREIGN_KEYS = {
    ("nation", "n_regionkey"): ("region", "r_regionkey"),
    ("customer", "c_nationkey"): ("nation", "n_nationkey"),
    ("supplier", "s_nationkey"): ("nation", "n_nationkey"),
    ("orders", "o_custkey"): ("customer", "c_custkey"),
    ("lineitem", "l_orderkey"): ("orders", "o_orderkey"),
    ("lineitem", "l_partkey"): ("part", "p_partkey"),
    ("lineitem", "l_suppkey"): ("supplier", "s_suppkey"),
    ("labels", "doc_id"): ("documents", "doc_id"),
}


class Tables:
    """Attribute access to the tables of a folder; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """A query over tables named in braces ({orders}) and over the given frames; no view is left behind."""
        import string

        used = {f for _, f, _, _ in string.Formatter().parse(text) if f}
        return self.spark.sql(text, **{n: frames[n] if n in frames else getattr(self, n) for n in used})


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = NAMES) -> None:
    """Make the tables temporary views, as generated SQL names them."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def healthy(spark: SparkSession) -> bool:
    """Whether the session answers a trivial query."""
    return spark.sql("SELECT 1 AS one").first()["one"] == 1


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of SQLite or MySQL (``jdbc:sqlite:...``, ``jdbc:mysql://...``); the driver's jar must be on the class path."""
    if not url.startswith(("jdbc:sqlite:", "jdbc:mysql:")):
        raise ValueError(f"only SQLite and MySQL are supported, not {url}")
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
