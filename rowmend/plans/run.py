"""Whole runs: compare one table, many tables at once, verify, report."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmend.operators import report
from rowmend.operators.columns import align
from rowmend.operators.diff import classify, diff
from rowmend.operators.sqlgen import statements
from rowmend.operators.stats import run_summary, run_totals, statistics
from rowmend.operators.store import once
from rowmend.operators.verify import valid, verify
from rowmend.sources.events import append_to_store
from rowmend.sources.io import write_csv, write_json
from rowmend.spec import TableSpec

SUMMARY = "table_name string, status string, source_schema string, target_schema string, source_row_count long, target_row_count long, insert_count long, update_count long, delete_count long, total_differences long, match_percentage double, match_percentage_clamped double, error_message string"


def compare_table(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """One summary row: keys checked, rows filtered, digested, matched and counted in one pass."""
    out = statistics(classify(align(source, target, spec)))
    return out.select(F.lit(spec.name).alias("table_name"), F.lit("SUCCESS").alias("status"), F.lit(spec.schema).alias("source_schema"), F.lit(spec.schema).alias("target_schema"), *out.columns, F.lit(None).cast("string").alias("error_message"))


def compare_tables(spark: SparkSession, tables: list[tuple[TableSpec, Callable[[], DataFrame], Callable[[], DataFrame]]], at_once: int = 4) -> DataFrame:
    """Summaries of several tables, compared at the same time; a table that fails gives an ERROR row, the others go on."""

    def one(item) -> list[tuple]:
        spec, source, target = item
        try:
            return [tuple(r) for r in compare_table(source(), target(), spec).collect()]  # one row a table
        except Exception as e:  # noqa: BLE001  a table's failure is its result
            return [(spec.name, "ERROR", spec.schema, spec.schema, None, None, None, None, None, None, None, None, str(e)[:1000])]

    with ThreadPoolExecutor(at_once) as pool:
        rows = [r for found in pool.map(one, tables) for r in found]
    return spark.createDataFrame(rows, SUMMARY)


def union_summaries(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def verified_statements(changes: DataFrame, current: DataFrame, spec: TableSpec, side: str = "target") -> DataFrame:
    """Statements of the changes that still hold on the side to be changed."""
    return statements(valid(verify(changes, current, list(spec.keys), spec.tags, spec.encoding == "compat")), spec, side)


def run_events(summaries: DataFrame, session_id: str) -> DataFrame:
    """Audit rows of a run: SESSION_START, TABLE_COMPLETE or ERROR for each table, SESSION_END."""
    details = F.to_json(F.struct("table_name", "total_differences", "match_percentage", "error_message"))
    tables = summaries.select(F.when(F.col("status") == "SUCCESS", "TABLE_COMPLETE").otherwise("ERROR").alias("event_type"), F.concat_ws(" ", "table_name", F.lower("status")).alias("message"), details.alias("details"))
    run = run_summary(summaries)
    start = run.select(F.lit("SESSION_START").alias("event_type"), F.concat(F.lit("tables: "), "tables").alias("message"), F.lit(None).cast("string").alias("details"))
    end = run.select(F.lit("SESSION_END").alias("event_type"), F.concat(F.lit("failed: "), "failed").alias("message"), F.to_json(F.struct("*")).alias("details"))
    every = start.unionByName(tables).unionByName(end)
    return every.select(F.current_timestamp().cast("timestamp_ntz").alias("timestamp"), F.lit(session_id).alias("session_id"), "event_type", "message", F.lit(0).cast("long").alias("thread_id"), "details")


def reports(changes: dict[str, DataFrame], summaries: DataFrame, keys: dict[str, list[str]], run_id: str) -> dict[str, DataFrame]:
    """All reports of a run by name: summaries, run and totals, statement numbers, samples and changed columns of all tables."""
    samples, values, columns, summaries = [], [], [], once(summaries)
    for name, df in changes.items():
        df, by, key = once(df), F.lit(name).alias("table_name"), F.to_json(F.struct(*keys[name])).alias("primary_key")
        samples.append(report.samples(df, keys[name]).select(by, key, "op", "sample", "source_hash", "target_hash"))
        values.append(report.sample_values(df, keys[name]).select(by, key, "op", "sample", "column", "value"))
        columns.append(report.changed_columns(df, keys[name], most=10).select(by, key, "column_name", "old_value", "new_value"))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return {
        "summary_csv": report.csv_summary(summaries),
        "summary_json": report.json_report(summaries, run_id),
        "run": run_summary(summaries),
        "totals": run_totals(summaries),
        "samples": union(samples),
        "sample_values": union(values),
        "changed_columns": union(columns),
    }


def recorded_run(spark: SparkSession, tables: list[tuple[TableSpec, Callable[[], DataFrame], Callable[[], DataFrame]]], path: str, session_id: str, at_once: int = 4) -> DataFrame:
    """Compare tables, append the run's own audit rows to the store at `path`/events, write its reports to `path`/reports.

    Returns the summaries. Samples and changed columns come from the tables that could be compared.
    """
    summaries = once(compare_tables(spark, tables, at_once))
    append_to_store(run_events(summaries, session_id), f"{path}/events")
    good = {r["table_name"] for r in summaries.where("status = 'SUCCESS'").select("table_name").collect()}  # one row a table
    compared = [(spec, source(), target()) for spec, source, target in tables if spec.name in good]
    changes = {spec.name: diff(a, b, spec) for spec, a, b in compared}
    if changes:
        write_reports(reports(changes, summaries, {spec.name: list(spec.keys) for spec, _, _ in compared}, session_id), f"{path}/reports/{session_id}")
    return summaries


def write_reports(made: dict[str, DataFrame], path: str) -> None:
    """Each report in a folder of its own: the CSV summary as CSV, the others as JSON lines."""
    for name, df in made.items():
        (write_csv if name.endswith("csv") else write_json)(df, f"{path}/{name}")
