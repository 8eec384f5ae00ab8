"""Samples, changed columns and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmend.functions.normalize import normalize, typed_equal


def samples(changes: DataFrame, keys: list[str], per_op: int = 5) -> DataFrame:
    """The first `per_op` changes of each op by key, with digests cut to 16 characters."""
    first = F.row_number().over(Window.partitionBy("op").orderBy(*keys))
    out = changes.withColumn("sample", first).where(F.col("sample") <= per_op)
    return out.select("op", "sample", *keys, F.substring("source_hash", 1, 16).alias("source_hash"), F.substring("target_hash", 1, 16).alias("target_hash"))


def sample_values(changes: DataFrame, keys: list[str], per_op: int = 5, columns: int = 10, width: int = 50, signed_zero: bool = False) -> DataFrame:
    """Samples with their first columns as text, cut to `width` characters."""
    first = F.row_number().over(Window.partitionBy("op").orderBy(*keys))
    out = changes.withColumn("sample", first).where(F.col("sample") <= per_op)
    fields = changes.schema["source_data"].dataType.fields[:columns]
    row = F.coalesce("source_data", "target_data")
    values = F.array(*[F.struct(F.lit(f.name).alias("column"), F.substring(normalize(row[f.name], f.dataType, None, signed_zero), 1, width).alias("value")) for f in fields])
    return out.select("op", "sample", *keys, F.inline(values))


def more_counts(changes: DataFrame, per_op: int = 5) -> DataFrame:
    """(op, total, more): how many changes of each op the samples leave out."""
    return changes.groupBy("op").agg(F.count("*").alias("total")).withColumn("more", F.greatest(F.lit(0), F.col("total") - per_op))


def changed_columns(changes: DataFrame, keys: list[str], tags: dict[str, str] | None = None, most: int | None = None, signed_zero: bool = False) -> DataFrame:
    """(keys, column_name, old_value, new_value) of every changed column of every update, or of its first `most`.

    `signed_zero` for change sets of `compat` digests, to which 0 and -0 differ.
    """
    tags = tags or {}
    fields = [f for f in changes.schema["source_data"].dataType if f.name not in keys]
    each = F.array(*[F.struct(F.lit(f.name).alias("column_name"), normalize(F.col(f"target_data.`{f.name}`"), f.dataType, tags.get(f.name), signed_zero).alias("old_value"), normalize(F.col(f"source_data.`{f.name}`"), f.dataType, tags.get(f.name), signed_zero).alias("new_value"), (~typed_equal(F.col(f"source_data.`{f.name}`"), F.col(f"target_data.`{f.name}`"), f.dataType, tags.get(f.name), signed_zero)).alias("changed")) for f in fields])
    kept = F.filter(each, lambda x: x["changed"])
    kept = F.slice(kept, 1, most) if most else kept
    return changes.where("op = 'UPDATE'").select(*keys, F.inline(kept)).drop("changed")


def changed_column_counts(changed: DataFrame) -> DataFrame:
    return changed.groupBy("column_name").agg(F.count("*").alias("updates"))


def csv_summary(summaries: DataFrame) -> DataFrame:
    """The 13 columns of the CSV summary."""
    # Headings.
    headings = {"table_name": "Table Name", "status": "Status", "source_schema": "Source Schema", "target_schema": "Target Schema", "source_row_count": "Source Row Count", "target_row_count": "Target Row Count", "insert_count": "Insert Count", "update_count": "Update Count", "delete_count": "Delete Count", "total_differences": "Total Differences", "match_percentage": "Match Percentage", "verification_status": "Verification Status", "error_message": "Error Message"}
    return summaries.select(*[(F.col(c) if c in summaries.columns else F.lit(None).cast("string")).alias(h) for c, h in headings.items()])


def json_report(summaries: DataFrame, run_id: str) -> DataFrame:
    """One row a table with its numbers nested, plus the run's id."""
    return summaries.select(F.lit(run_id).alias("run_id"), "table_name", F.struct(*[c for c in summaries.columns if c != "table_name"]).alias("result"))
