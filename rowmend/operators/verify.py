"""Verification: does each change still hold against the current state of the side to be changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmend.functions.normalize import typed_equal
from rowmend.operators.checks import strings_fit
from rowmend.operators.diff import same_key
from rowmend.operators.store import once, small

# Verdicts.
ABSENT, LENGTH, PRESENT = "Primary key does not exist in target", "Data validation failed", "Primary key already exists in target"
SAME, CHANGED, GONE = "Row exists and matches expected data", "Row data changed since comparison", "Row not found in target"
EXISTS = "Row exists in target"


def verify(changes: DataFrame, current: DataFrame, keys: list[str], tags: dict[str, str] | None = None, signed_zero: bool = False) -> DataFrame:
    """`changes` with verification_status, verification_reason and current_data (updates only).

    The change set is computed once. The current rows of its keys are found by a semi join (a few keys are broadcast, so
    that the large side is only scanned), then joined to the changes.
    """
    changes = once(changes)
    tags = tags or {}
    schema = changes.schema["target_data"].dataType
    columns = [f.name for f in schema]
    touched = current.alias("s").join(small(changes.select(*keys)).alias("t"), same_key(keys), "left_semi")
    now = touched.select(*keys, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("current_data"), F.lit(True).alias("there")).alias("t")
    both = changes.alias("s").join(now, same_key(keys), "left")
    there = F.col("t.there").isNotNull()
    same = reduce(lambda a, b: a & b, [typed_equal(F.col(f"s.target_data.`{f.name}`"), F.col(f"t.current_data.`{f.name}`"), f.dataType, tags.get(f.name), signed_zero) for f in schema], F.lit(True))
    op, fits = F.col("s.op"), strings_fit("s.source_data", changes.schema["source_data"].dataType)
    reason = (
        F.when(op == "INSERT", F.when(there, PRESENT).when(~fits, LENGTH).otherwise(ABSENT))
        .when(op == "UPDATE", F.when(~there, GONE).when(same, SAME).otherwise(CHANGED))
        .otherwise(F.when(there, EXISTS).otherwise(GONE))
    )
    status = F.when(reason.isin(ABSENT, SAME, EXISTS), "VALID").otherwise("INVALID")
    return both.select("s.*", status.alias("verification_status"), reason.alias("verification_reason"), F.when(op == "UPDATE", F.col("t.current_data")).alias("current_data"))


def valid(verified: DataFrame) -> DataFrame:
    return verified.where(F.col("verification_status") == "VALID")


def verification_statistics(verified: DataFrame) -> DataFrame:
    """(op, original, valid, invalid, valid_percentage) for each op and in total (op TOTAL)."""
    out = verified.rollup("op").agg(F.count("*").alias("original"), F.count_if(F.col("verification_status") == "VALID").alias("valid"))
    share = F.when(F.col("original") == 0, 100.0).otherwise(F.round(100.0 * F.col("valid") / F.greatest("original", F.lit(1)), 2))
    return out.select(F.coalesce("op", F.lit("TOTAL")).alias("op"), "original", "valid", (F.col("original") - F.col("valid")).alias("invalid"), share.alias("valid_percentage"))


def verification_rollup(verified: DataFrame) -> DataFrame:
    """(tables_verified, total_valid) over verified changes with a table_name."""
    return verified.agg(F.count_distinct("table_name").alias("tables_verified"), F.count_if(F.col("verification_status") == "VALID").alias("total_valid"))
