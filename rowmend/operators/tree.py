"""Comparison of nearly equal tables by trees of mergeable checksums over key ranges.

Each side is scanned once and leaves one checksum a key range; a node above merges those of `FAN` nodes. The trees are
small tables that can be kept, or built where the data is. They are compared from the root down, only below nodes that
differ, and only rows in the ranges of differing leaves are read again, digested, shuffled and joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmend.operators.columns import align, find
from rowmend.operators.diff import classify
from rowmend.operators.ranges import KeyRanges, between, key_ranges, runs, span, with_range
from rowmend.operators.store import kept, release
from rowmend.spec import TableSpec

FAN = 32
#: Runs of neighbouring ranges that a filter names one by one; with more, it names the span from the first to the last.
RUNS = 64


def _merged(df: DataFrame, node: Column) -> DataFrame:
    return df.groupBy(node.alias("node")).agg(F.sum("rows").alias("rows"), F.bit_xor("one").alias("one"), F.sum("two").alias("two"))


def checksum_tree(side: DataFrame, ranges: KeyRanges, fan: int = FAN) -> DataFrame:
    """(level, node, rows, one, two) of an aligned side (keys and row_hash): leaves on level 0, one root on the last level."""
    row = with_range(side, ranges)
    of = lambda seed: F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in ranges.keys], F.col("row_hash"))
    leaves = row.select("range_no", F.lit(1).cast("long").alias("rows"), of(0).alias("one"), F.shiftrightunsigned(of(1), 40).alias("two"))
    level = kept(_merged(leaves, F.col("range_no")))
    out, made, width, number = level.withColumn("level", F.lit(0)), [level], ranges.table.count(), 0
    while width > 1:
        level, number, width = _merged(level, F.floor(F.col("node") / fan).cast("int")), number + 1, -(-width // fan)
        out = out.unionByName(level.withColumn("level", F.lit(number)))
    tree = kept(out.select("level", "node", "rows", "one", "two"))
    release(*made)
    return tree


def differing(source: DataFrame, target: DataFrame, fan: int = FAN) -> list[int]:
    """Numbers of the leaves whose checksums differ, or that only one tree has; nodes below equal ones aren't looked at."""
    top = source.unionByName(target).agg(F.max("level")).first()[0]
    if top is None:
        return []
    below = None
    for level in range(top, -1, -1):
        a, b = (t.where(F.col("level") == level) for t in (source, target))
        if below is not None:
            parents = source.sparkSession.createDataFrame([(n,) for n in below], "parent int")
            a, b = (t.join(F.broadcast(parents), F.floor(F.col("node") / fan) == F.col("parent"), "left_semi") for t in (a, b))
        both = a.alias("a").join(b.alias("b"), "node", "full_outer")
        same = F.col("a.rows").eqNullSafe(F.col("b.rows")) & F.col("a.one").eqNullSafe(F.col("b.one")) & F.col("a.two").eqNullSafe(F.col("b.two"))
        below = [r["node"] for r in both.where(~same).select("node").collect()]  # at most one row a range
        if not below:
            break
    return sorted(below or [])


def limited(df: DataFrame, keys: list[str], types: dict, ranges: KeyRanges, numbers: list[int]) -> DataFrame:
    """The rows of `df` in some ranges, as a filter that scans and databases can take over."""
    columns = [F.col(f"`{find(df, k)}`").cast(types[k]) for k in keys]
    parts, listed = runs(numbers), ranges.rows()
    if not parts:
        return df.where(F.lit(False))
    if len(parts) > RUNS:
        parts = [(parts[0][0], parts[-1][1])]
    return df.where(reduce(lambda a, b: a | b, [between(columns, *span(listed, first, last)) for first, last in parts]))


def tree_diff(source: DataFrame, target: DataFrame, spec: TableSpec, rows: int = 10_000, ranges: KeyRanges | None = None) -> DataFrame:
    """`diff` for tables that are almost equal: the same change set, with the joins limited to key ranges that differ.

    `ranges` may be those of an earlier run; else they are made from the source's keys. Runs its two scans when called.
    Duplicate keys are looked for in differing ranges only.
    """
    bare = TableSpec(**{**spec.__dict__, "duplicates": "unique"})
    m = align(source, target, bare)
    ranges = ranges or key_ranges(m.source, m.keys, rows)
    trees = [checksum_tree(side, ranges) for side in (m.source, m.target)]
    numbers = differing(*trees)
    release(*trees)
    sides = [limited(df, m.keys, m.types, ranges, numbers) for df in (source, target)]
    return classify(align(*sides, spec)).where("op <> 'MATCH'")
