"""The event store of runs: JSON-like audit rows in one folder a day, appended by every run, kept for some days."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmend.operators.audit import EVENT
from rowmend.operators.store import delete, kept, release

STORED = f"{EVENT}, day date"


def append_to_store(events: DataFrame, path: str) -> None:
    """Add events to their days' folders; a run adds files and rewrites none."""
    events.withColumn("day", F.to_date("timestamp")).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def stored_events(spark: SparkSession, path: str) -> DataFrame:
    """All events; filters on `day` leave out whole folders. An absent store is empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(path)


def retain(spark: SparkSession, path: str, days: int, now: datetime) -> dict[str, int]:
    """Drop events older than `days` days before `now`: whole folders are removed, only the border day is rewritten.

    Returns how many days were dropped and rewritten. The border day's new rows are written beside the store first.
    """
    border = now - timedelta(days=days)
    events = stored_events(spark, path)
    old = sorted(r["day"] for r in events.select("day").where(F.col("day") < F.lit(border.date())).distinct().collect())  # one row a day
    for day in old:
        delete(spark, f"{path}/day={day}")
    rest = stored_events(spark, path).where(F.col("day") == F.lit(border.date()))
    early = rest.where(F.col("timestamp") < F.lit(border).cast("timestamp_ntz"))
    if early.isEmpty():
        return {"dropped": len(old), "rewritten": 0}
    stay = kept(rest.where(F.col("timestamp") >= F.lit(border).cast("timestamp_ntz")))
    if stay.isEmpty():
        delete(spark, f"{path}/day={border.date()}")
    else:
        stay.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    release(stay)
    spark.catalog.refreshByPath(path)
    return {"dropped": len(old), "rewritten": 1}
