"""A change set merged into a stored table: only the partitions that it touches are read again and rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowmend.operators.diff import same_key
from rowmend.operators.store import delete, kept, release, small


def touched_partitions(table: DataFrame, changes: DataFrame, keys: list[str], partition: str) -> list:
    """Values of the partition column of the rows that go and of those that come; at most one a partition.

    Rows under the key of an insert count as going, too: they can only be there from an earlier try.
    """
    old = table.select(*keys, partition).alias("s").join(small(changes.select(*keys)).alias("t"), same_key(keys), "left_semi").select(partition)
    new = changes.where("op <> 'DELETE'").select(F.col(f"source_data.`{partition}`").alias(partition))
    return [r[0] for r in old.unionByName(new).distinct().collect()]


def merge_changes(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], partition: str, schema: str | StructType | None = None) -> list:
    """Apply `changes` to the Parquet table at `path`, which is partitioned by `partition`; returns the partitions rewritten.

    The change set is saved first and the new rows of the touched partitions are written beside the table, so an
    interrupted merge leaves the table as it was until the last step, Spark's dynamic overwrite, replaces the touched
    partitions' folders at the end of its job. A merge that ends within that step can be run again: a change set applied
    twice gives the same rows. Partitions left without rows lose their folder. Files of all other partitions stay. Null
    partition values and values that move a row to another partition are handled like any other. `schema`: for partition
    columns whose type can't be told from the folders' names (texts such as `01`).
    """
    reader = spark.read.schema(schema) if schema else spark.read
    table, changes = reader.parquet(path), kept(changes)
    values = touched_partitions(table, changes, keys, partition)
    if not values:
        release(changes)
        return []
    schema = table.schema
    inside = F.col(partition).isin([v for v in values if v is not None])
    inside = inside | F.col(partition).isNull() if None in values else inside
    stays = table.where(inside).alias("s").join(small(changes.select(*keys)).alias("t"), same_key(keys), "left_anti")
    comes = changes.where("op <> 'DELETE'").select("source_data.*")
    typed = [df.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema]) for df in (stays, comes)]
    ready = kept(typed[0].unionByName(typed[1]).repartition(F.col(partition), F.pmod(F.xxhash64(*keys), F.lit(8))))
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    left = {r[0] for r in ready.select(partition).distinct().collect()}
    for value in values:
        if value not in left:
            delete(spark, f"{path}/{partition}={_folder(spark, value)}")
    release(ready, changes)
    spark.catalog.refreshByPath(path)
    return sorted(values, key=lambda v: (v is not None, v))


def _folder(spark: SparkSession, value) -> str:
    """A partition value as Spark writes it in folder names."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(text)
