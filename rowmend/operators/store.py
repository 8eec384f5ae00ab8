"""Results that several parts of a plan read: computed once, kept in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder. Only a local session that has none gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/kept-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """`df` written as Parquet (to the shared folder unless `path` is given) and read back, with pruning and push-down."""
    path = path or folder(df.sparkSession)
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in `path` that were written to their end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return sorted(n for n in names if exists(spark, f"{path}/{n}"))


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*frames: DataFrame) -> None:
    """Delete what `kept` wrote to the shared folder for these tables, once nothing reads them any more."""
    for df in frames:
        for held in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/kept-" in held:
                delete(df.sparkSession, held)


def once(df: DataFrame) -> DataFrame:
    """`df` checkpointed: its plan runs once, and what reads it survives lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(base)
    return df.checkpoint()


def small(keys: DataFrame, rows: int = 100_000) -> DataFrame:
    """`keys` (kept by `once`, of a few narrow columns) marked for broadcast if it has at most `rows` rows; else as it is."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys
