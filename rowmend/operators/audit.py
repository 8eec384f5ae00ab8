"""Audit events as rows: roll-ups, last metrics, durations, errors, retention and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "timestamp timestamp_ntz, session_id string, event_type string, message string, thread_id long, details string"


def of_type(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind)


def event_counts(events: DataFrame) -> DataFrame:
    """(session_id, event_type, n), with a total for each session (event_type ALL)."""
    out = events.groupBy("session_id", "event_type").agg(F.count("*").alias("n"))
    total = events.groupBy("session_id").agg(F.count("*").alias("n"))
    return out.unionByName(total.select("session_id", F.lit("ALL").alias("event_type"), "n"))


def tables_seen(events: DataFrame) -> DataFrame:
    return events.select("session_id", F.get_json_object("details", "$.table_name").alias("table_name")).where("table_name is not null").distinct()


def last_metrics(events: DataFrame) -> DataFrame:
    """The last value and unit of each metric; of equal times the larger message."""
    m = of_type(events, "PERFORMANCE_METRIC").select("session_id", F.get_json_object("details", "$.metric_name").alias("metric_name"), "timestamp", "message", F.get_json_object("details", "$.value").cast("double").alias("value"), F.get_json_object("details", "$.unit").alias("unit"))
    out = m.groupBy("session_id", "metric_name").agg(F.max_by(F.struct("value", "unit"), F.struct("timestamp", "message")).alias("last"))
    return out.select("session_id", "metric_name", "last.value", "last.unit")


def durations(events: DataFrame) -> DataFrame:
    """Seconds from a session's first SESSION_START to its last event."""
    out = events.groupBy("session_id").agg(F.max("timestamp").alias("end"), F.min(F.when(F.col("event_type") == "SESSION_START", F.col("timestamp"))).alias("start"))
    return out.select("session_id", F.timestamp_diff("SECOND", "start", "end").alias("seconds"))


def problems(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin("ERROR", "WARNING")).select("session_id", "event_type", "timestamp", "message", "details")


def progress(events: DataFrame) -> DataFrame:
    """Percentage of batches done, by BATCH_PROGRESS event."""
    e = of_type(events, "BATCH_PROGRESS")
    done, total = (F.get_json_object("details", f"$.{n}").cast("double") for n in ("batch_number", "total_batches"))
    return e.select("session_id", "timestamp", F.round(F.when(total > 0, 100 * done / total), 2).alias("percentage"))


def retained(events: DataFrame, days: int, now: str) -> DataFrame:
    """Events of the last `days` days before `now` (a timestamp text)."""
    return events.where(F.col("timestamp") >= F.expr(f"timestamp_ntz'{now}' - interval {int(days)} days"))


def unfinished(keys: DataFrame, ledger: DataFrame, on: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return keys.join(ledger.select(*on).distinct(), on, "left_anti")
