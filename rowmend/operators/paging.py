"""Global row numbers and pages without a single partition, by key ranges with exact counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmend.operators import ranges as key


def with_row_number(df: DataFrame, keys: list[str], name: str = "rn", ranges: key.KeyRanges | None = None) -> DataFrame:
    """`df` with row_number() over all rows ordered by `keys`: numbered within each range, plus the rows of the ranges before.

    `ranges` of an earlier call over the same rows saves making them, which runs two jobs over the keys.
    """
    ranges = ranges or key.key_ranges(df, keys)
    before = ranges.table.select("range_no", F.col("before").alias("_before"))
    within = F.row_number().over(Window.partitionBy("range_no").orderBy(*keys))
    return key.with_range(df, ranges).withColumn(name, within).join(F.broadcast(before), "range_no").withColumn(name, F.col(name) + F.col("_before")).drop("range_no", "_before")


def page(df: DataFrame, keys: list[str], number: int, size: int, ranges: key.KeyRanges | None = None) -> DataFrame:
    """Page `number` (from 0) of `size` rows in key order; with `ranges` kept from an earlier call, one filtered scan."""
    return key.page(df, ranges or key.key_ranges(df, keys, max(size, 1)), number, size)
