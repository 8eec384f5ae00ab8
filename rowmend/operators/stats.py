"""Counts and percentages of comparisons and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def statistics(classified: DataFrame) -> DataFrame:
    """One row: source and target rows, changes by kind, their total, match percentage (may be negative) and clamped."""
    out = classified.agg(
        F.count_if(F.col("op") != "DELETE").alias("source_row_count"),
        F.count_if(F.col("op") != "INSERT").alias("target_row_count"),
        F.count_if(F.col("op") == "INSERT").alias("insert_count"),
        F.count_if(F.col("op") == "UPDATE").alias("update_count"),
        F.count_if(F.col("op") == "DELETE").alias("delete_count"),
    )
    out = out.withColumn("total_differences", F.col("insert_count") + F.col("update_count") + F.col("delete_count"))
    return with_percentage(out, "source_row_count", "target_row_count", "total_differences")


def with_percentage(df: DataFrame, source: str, target: str, changes: str) -> DataFrame:
    most = F.greatest(source, target)
    share = F.round(F.when(most == 0, 0.0).otherwise(100.0 * (most - F.col(changes)) / F.greatest(most, F.lit(1))), 2)
    return df.withColumn("match_percentage", share).withColumn("match_percentage_clamped", F.greatest(F.lit(0.0), "match_percentage"))


def row_count(df: DataFrame, where: str | None = None) -> DataFrame:
    return (df.where(F.expr(where)) if where else df).agg(F.count("*").alias("row_count"))


def page_counts(counts: DataFrame, size: int) -> DataFrame:
    """`counts` (source_row_count, target_row_count) with the number of pages: ceil of the larger side."""
    return counts.withColumn("pages", F.ceil(F.greatest("source_row_count", "target_row_count") / size).cast("long"))


def run_summary(summaries: DataFrame) -> DataFrame:
    """Over summaries of tables (status, total_differences): tables, succeeded, failed, differences, tables to synchronise."""
    ok = F.col("status") == "SUCCESS"
    return summaries.agg(F.count("*").alias("tables"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("total_differences"))), F.lit(0)).alias("total_differences"), F.count_if(ok & (F.col("total_differences") > 0)).alias("tables_needing_sync"))


def run_totals(summaries: DataFrame) -> DataFrame:
    """Sums over successful tables and the overall match percentage."""
    names = ["source_row_count", "target_row_count", "insert_count", "update_count", "delete_count", "total_differences"]
    out = summaries.where("status = 'SUCCESS'").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    most = F.greatest("source_row_count", "target_row_count")
    return out.withColumn("match_percentage", F.when(most > 0, F.round(100.0 * (most - F.col("total_differences")) / F.greatest(most, F.lit(1)), 2)))


def statement_counts(statements: DataFrame) -> DataFrame:
    return statements.groupBy("table_name", "side", "op").agg(F.count("*").alias("statements"))


def has_differences(summaries: DataFrame) -> DataFrame:
    return summaries.withColumn("has_differences", F.col("insert_count") + F.col("update_count") + F.col("delete_count") > 0)
