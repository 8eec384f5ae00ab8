"""Audit roll-up of events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmend.operators.audit import EVENT


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a folder as a stream; malformed lines are skipped."""
    return spark.readStream.schema(EVENT.replace("timestamp_ntz", "timestamp")).option("mode", "DROPMALFORMED").json(path)


def windowed_counts(events: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; events later than `late` are left out of closed windows."""
    out = events.withWatermark("timestamp", late).groupBy(F.window("timestamp", every), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")
