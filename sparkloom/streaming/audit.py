"""Streams over the logs and events: running audits, tumbling and session windows with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import TRACE


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Traces as they are appended to a folder of JSON lines."""
    return spark.readStream.schema(TRACE).json(folder)


def running_decisions(traces: DataFrame) -> DataFrame:
    return traces.groupBy("decision").agg(F.count("*").alias("n"))


def running_errors(traces: DataFrame) -> DataFrame:
    errors = traces.select(F.explode("iterations").alias("i")).select(F.explode("i.errors").alias("e"))
    return errors.groupBy(F.col("e.type").alias("error_type")).agg(F.count("*").alias("n"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; rows later than the watermark are left out of closed windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, closed after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
