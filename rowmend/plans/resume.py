"""A comparison that can be stopped and taken up again: by key ranges, with a ledger of those that are done.

In its folder: `ranges` (the key ranges, made once), `spec` (what is compared), `changes/waves=A-B` and `ledger/waves=A-B`.
A wave is some neighbouring ranges, a round some neighbouring waves. A round's change set is written first and the ledger
rows of its waves last, each as a whole, so waves without a finished ledger folder count as not done and are written anew.
Only unfinished waves read from the tables, by a range filter on the keys that scans and databases take over. A call has at
most about `ROUNDS` rounds, whatever the number of waves: each wave that a stop loses is one of its round's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmend.operators.columns import align
from rowmend.operators.diff import diff
from rowmend.operators.ranges import KeyRanges, key_ranges, load_ranges, runs, with_range
from rowmend.operators.store import exists, finished, kept
from rowmend.operators.tree import limited
from rowmend.spec import TableSpec


#: Rounds a call (and one more for each gap among the waves that are left).
ROUNDS = 16


class OtherRunError(ValueError):
    """The folder belongs to a comparison with another spec or other columns."""


def waves(ranges: KeyRanges, size: int) -> dict[int, list[int]]:
    n = ranges.table.count()
    return {w: list(range(w * size, min(n, (w + 1) * size))) for w in range(-(-n // size))}


def unfinished_waves(ranges: KeyRanges, path: str, size: int) -> dict[int, list[int]]:
    """Waves that no finished ledger folder covers."""
    ends = [[int(n) for n in name.split("=")[1].split("-")] for name in done(ranges.table.sparkSession, path)]
    covered = {w for first, last in ends for w in range(first, last + 1)}
    return {w: numbers for w, numbers in waves(ranges, size).items() if w not in covered}


def done(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders of finished rounds."""
    return [name for name in finished(spark, f"{path}/ledger") if name.startswith("waves=")]


def rounds(left: list[int]) -> list[tuple[int, int]]:
    """Waves dealt to rounds, as (first, last)."""
    each = max(1, -(-len(left) // ROUNDS))
    return [(a, min(a + each - 1, last)) for first, last in runs(left) for a in range(first, last + 1, each)]


def resumable_diff(source: DataFrame, target: DataFrame, spec: TableSpec, path: str, rows: int = 1_000_000, size: int = 8, most: int | None = None) -> DataFrame:
    """The change set as `diff` gives it, from all waves that are done; `most`: how many waves to do in this call.

    `rows`: rows of the source a range; `size`: ranges a wave. Both sides should hold still between calls, or be read at
    one snapshot.
    """
    spark = source.sparkSession
    m = align(source, target, TableSpec(**{**spec.__dict__, "duplicates": "unique"}))
    said = f"{spec} {m.types} {rows} {size}"
    if not exists(spark, f"{path}/ranges"):
        kept(spark.range(1).select(F.lit(said).alias("spec")), f"{path}/spec", "overwrite")
        key_ranges_at(m.source, m.keys, rows, f"{path}/ranges")
    if spark.read.parquet(f"{path}/spec").first()["spec"] != said:
        raise OtherRunError(f"{path} belongs to another comparison")
    ranges = load_ranges(spark, f"{path}/ranges")
    todo = unfinished_waves(ranges, path, size)
    for first, last in rounds(sorted(todo)[:most]):
        numbers = [n for wave in range(first, last + 1) for n in todo[wave]]
        sides = [limited(df, m.keys, m.types, ranges, numbers) for df in (source, target)]
        found = kept(diff(*sides, spec), f"{path}/changes/waves={first}-{last}", "overwrite")
        by_wave(found, ranges, first, last, size).withColumn("finished", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/ledger/waves={first}-{last}")
    return changes(diff(source, target, spec), path)


def by_wave(found: DataFrame, ranges: KeyRanges, first: int, last: int, size: int) -> DataFrame:
    """(wave, inserts, updates, deletes) of every wave of a round, from the round's change set."""
    counts = [F.count_if(F.col("op") == op).alias(name) for op, name in (("INSERT", "inserts"), ("UPDATE", "updates"), ("DELETE", "deletes"))]
    if first == last:
        return found.groupBy().agg(*counts).select(F.lit(first).alias("wave"), "*")
    ops = with_range(found.select("op", *[F.col(f"`{k}`") for k in ranges.keys]), ranges)
    some = ops.groupBy(F.floor(F.col("range_no") / size).cast("int").alias("wave")).agg(*counts)
    every = found.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("wave"))
    return every.join(some, "wave", "left").fillna(0)


def key_ranges_at(side: DataFrame, keys: list[str], rows: int, path: str) -> None:
    """The ranges at `path`; what an interrupted call has left there goes."""
    made = key_ranges(side, keys, rows)
    kept(made.table, path, "overwrite")


def changes(like: DataFrame, path: str) -> DataFrame:
    """The change sets of the finished rounds, with the columns of `like`."""
    spark = like.sparkSession
    held = [f"{path}/changes/{name}" for name in done(spark, path)]
    return spark.read.schema(like.schema).parquet(*held) if held else spark.createDataFrame([], like.schema)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(wave, inserts, updates, deletes, finished) of what is done."""
    schema = "wave int, inserts long, updates long, deletes long, finished timestamp"
    held = [f"{path}/ledger/{name}" for name in done(spark, path)]
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)
