"""Key ranges of a table: a saved list of bounds and counts by which pages, comparisons and reads go on.

A list has one row a range: range_no (from 0), lo (the smallest key of the range as a struct), rows and before (rows of all
ranges before it). Ranges cover all keys: the first has no lower end, the last no upper one. Keys are in Spark's order,
nulls first. Rows with one key lie in one range. An empty table has a single range without rows and with null keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from math import ceil
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmend.operators.store import kept


#: Most ranges of a list, whatever the table's size: what is broadcast (`with_range`) or listed on the driver is bounded by it.
MOST = 32_768
#: Rows of a task that makes ranges, and most such tasks.
TASK_ROWS = 250_000
TASKS = 2_048


@dataclass(frozen=True)
class KeyRanges:
    keys: list[str]
    table: DataFrame

    @cached_property
    def _listed(self) -> list[Any]:
        return self.table.orderBy("range_no").collect()

    def rows(self) -> list[Any]:
        """All ranges in order, on the driver, fetched once: at most `MOST`."""
        return self._listed


def key_ranges(df: DataFrame, keys: list[str], rows: int = 100_000, path: str | None = None) -> KeyRanges:
    """Ranges of about `rows` rows each, or of more where that makes more than `MOST`; exact counts.

    Only the keys are shuffled, once, to tasks of about `TASK_ROWS` rows, which cut their sorted keys into ranges: tasks
    and the keys that Spark samples for them don't grow with the number of ranges. The list is saved (at `path`).
    """
    total = df.count()
    tasks = min(TASKS, max(1, ceil(total / TASK_ROWS)))
    size = max(1, ceil(total / min(MOST - tasks, max(1, ceil(total / rows)))))
    columns = [F.col(f"`{k}`") for k in keys]
    at, key = F.col("_at"), F.struct(*columns)
    dealt = df.select(*columns).repartitionByRange(tasks, *columns).sortWithinPartitions(*columns)
    # A key is counted where its first row is, so that one key lies in one range. Equal keys are in one task already.
    each = dealt.withColumn("_at", F.monotonically_increasing_id()).groupBy(*columns).agg(F.min("_at").alias("_at"), F.count("*").alias("_rows"))
    task, number = F.shiftright(at, 33), F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / size)
    found = each.groupBy(task.alias("_task"), number.alias("_number")).agg(F.min(key).alias("lo"), F.sum("_rows").alias("rows")).select("lo", "rows")
    if not total:
        found = df.sparkSession.range(1).select(F.struct(*[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]).alias("lo"), F.lit(0).cast("long").alias("rows"))
    order = Window.orderBy("lo")  # one row a range
    listed = found.select((F.row_number().over(order) - 1).alias("range_no"), "lo", "rows", (F.sum("rows").over(order) - F.col("rows")).alias("before"))
    return KeyRanges(list(keys), kept(listed, path))


def load_ranges(spark: SparkSession, path: str) -> KeyRanges:
    table = spark.read.parquet(path)
    return KeyRanges(table.schema["lo"].dataType.names, table)


def _from(columns: list[Column], bound: list[Any]) -> Column:
    c, b = columns[0], bound[0]
    above, same = (c.isNotNull(), c.isNull()) if b is None else (c > F.lit(b), c == F.lit(b))
    return above | (same & (_from(columns[1:], bound[1:]) if len(bound) > 1 else F.lit(True)))


def _below(columns: list[Column], bound: list[Any]) -> Column:
    c, b = columns[0], bound[0]
    under, same = (F.lit(False), c.isNull()) if b is None else ((c < F.lit(b)) | c.isNull(), c == F.lit(b))
    return under | (same & (_below(columns[1:], bound[1:]) if len(bound) > 1 else F.lit(False)))


def between(columns: list[Column], lo: tuple | None, hi: tuple | None) -> Column:
    """Keys from `lo` up to but without `hi`; None is no end. Made of plain comparisons, which scans and databases take over."""
    first, out = columns[0], F.lit(True)
    if lo is not None:
        out = (first >= F.lit(lo[0]) if lo[0] is not None else F.lit(True)) & _from(columns, list(lo))
    if hi is not None:
        most = first.isNull() if hi[0] is None else first <= F.lit(hi[0])
        out = out & (most if lo is not None and lo[0] is not None else most | first.isNull()) & _below(columns, list(hi))
    return out


def span(listed: list[Any], first: int, last: int) -> tuple[tuple | None, tuple | None]:
    """Ends of the ranges `first` to `last`."""
    return (tuple(listed[first]["lo"]) if first else None), (tuple(listed[last + 1]["lo"]) if last + 1 < len(listed) else None)


def runs(numbers: list[int]) -> list[tuple[int, int]]:
    """Neighbouring numbers as (first, last)."""
    out: list[tuple[int, int]] = []
    for n in sorted(numbers):
        if out and out[-1][1] == n - 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def with_range(df: DataFrame, ranges: KeyRanges, fan: int = 32) -> DataFrame:
    """`df` with the number of the range of its key: down a search tree of `fan` children, one broadcast row a node."""
    n, stride = ranges.table.count(), 1
    while stride * fan < n:
        stride *= fan
    key = F.struct(*[F.col(f"`{k}`") for k in ranges.keys])
    out = df.withColumn("range_no", F.lit(0))
    while stride:
        at = F.col("range_no")
        inner = ranges.table.where((at % stride == 0) & (F.floor(at / stride) % fan > 0))
        bounds = inner.groupBy(F.floor(at / (stride * fan)).cast("int").alias("_node")).agg(F.array_sort(F.collect_list("lo")).alias("_bounds"))
        out = out.join(F.broadcast(bounds), F.col("range_no") == F.col("_node"), "left")
        passed = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= key)), F.lit(0))
        out = out.withColumn("range_no", F.col("range_no") * fan + F.greatest(passed, F.lit(0))).drop("_node", "_bounds")
        stride //= fan
    return out


def page(df: DataFrame, ranges: KeyRanges, number: int, size: int, name: str = "rn") -> DataFrame:
    """Page `number` (from 0) of `size` rows in key order, with row numbers: only the ranges that hold it are read.

    The rows that are sorted are those of a page and of the two ranges at its ends.
    """
    first, end = number * size, (number + 1) * size
    listed = ranges.rows()
    held = [r["range_no"] for r in listed if r["before"] < end and r["before"] + r["rows"] > first]
    columns = [F.col(f"`{k}`") for k in ranges.keys]
    if not held:
        return df.where(F.lit(False)).withColumn(name, F.lit(0).cast("long"))
    inside = df.where(between(columns, *span(listed, held[0], held[-1])))
    numbered = inside.withColumn(name, F.row_number().over(Window.orderBy(*columns)) + F.lit(listed[held[0]]["before"]))
    return numbered.where((F.col(name) > first) & (F.col(name) <= end))
