"""Table diff: one full outer join on null-safe keys, and its parts as inner and anti joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmend.operators.columns import Matched, align
from rowmend.operators.store import once, small
from rowmend.spec import TableSpec


def same_key(keys: list[str], left: str = "s", right: str = "t") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys])


def data(side: str, columns: list[str], name: str) -> Column:
    return F.struct(*[F.col(f"{side}.`{c}`").alias(c) for c in columns]).alias(name)


def same_marks(m: Matched) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"s.{c}") == F.col(f"t.{c}") for c in m.marks()])


def classify(m: Matched) -> DataFrame:
    """Every key once: op (INSERT, UPDATE, DELETE or MATCH), keys, digests and both rows."""
    s = m.left.withColumn("in_source", F.lit(True)).alias("s")
    t = m.right.withColumn("in_target", F.lit(True)).alias("t")
    there, here = F.col("t.in_target").isNotNull(), F.col("s.in_source").isNotNull()
    op = F.when(~there, "INSERT").when(~here, "DELETE").when(F.col("s.row_hash") != F.col("t.row_hash"), "UPDATE").otherwise("MATCH")
    both = s.join(t, same_marks(m), "full_outer")
    everything = [*m.keys, *m.values]
    return both.select(
        op.alias("op"),
        *[F.when(here, F.col(f"s.`{k}`")).otherwise(F.col(f"t.`{k}`")).alias(k) for k in m.keys],
        F.col("s.row_hash").alias("source_hash"),
        F.col("t.row_hash").alias("target_hash"),
        F.when(here, data("s", everything, "d")).alias("source_data"),
        F.when(there, data("t", everything, "d")).alias("target_data"),
    )


def diff(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """The change set that makes target equal source: op, keys, source_hash, target_hash, source_data, target_data."""
    return classify(align(source, target, spec)).where("op <> 'MATCH'")


def inserts(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows of source whose key target lacks."""
    m = align(source, target, spec)
    return m.left.alias("s").join(m.right.select(*m.marks()).alias("t"), same_marks(m), "left_anti").drop(*m.marks())


def deletes(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows of target whose key source lacks."""
    m = align(source, target, spec)
    return m.right.alias("s").join(m.left.select(*m.marks()).alias("t"), same_marks(m), "left_anti").drop(*m.marks())


def updates(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """Keys on both sides whose digests differ: keys, source_hash, target_hash, source_data, target_data."""
    m = align(source, target, spec)
    both = m.left.alias("s").join(m.right.alias("t"), same_marks(m)).where("s.row_hash <> t.row_hash")
    return both.select(*[F.col(f"s.`{k}`").alias(k) for k in m.keys], F.col("s.row_hash").alias("source_hash"), F.col("t.row_hash").alias("target_hash"), data("s", [*m.keys, *m.values], "source_data"), data("t", [*m.keys, *m.values], "target_data"))


def thin_diff(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """`diff` for wide rows: joins keys and digests only, then fetches the rows of the differing keys by semi joins.

    The differing keys are computed once; few of them are broadcast, so that the wide sides aren't shuffled.
    """
    m = align(source, target, spec)
    thin = Matched(m.source, m.target, m.keys, [], m.types, *m.thin())
    found = once(classify(thin).where("op <> 'MATCH'").drop("source_data", "target_data"))
    touched, out = small(found.select(*m.keys)), found.alias("s")
    for side, df, name in (("x", m.source, "source_data"), ("y", m.target, "target_data")):
        rows = df.alias("s").join(touched.alias("t"), same_key(m.keys), "left_semi")
        rows = rows.select(*m.keys, F.struct(*[F.col(f"`{c}`") for c in [*m.keys, *m.values]]).alias(name)).alias(side)
        out = out.join(rows, same_key(m.keys, "s", side), "left").select("s.*", f"{side}.{name}").alias("s")
    return out.select("op", *m.keys, "source_hash", "target_hash", "source_data", "target_data")


def changed_buckets(source: DataFrame, target: DataFrame, spec: TableSpec, buckets: int = 1024) -> DataFrame:
    """Key buckets whose checksums differ: a first look at tables that are almost equal."""
    m = align(source, target, spec)

    def sums(df, side):
        bucket = F.pmod(F.xxhash64(*m.keys), F.lit(buckets)).alias("bucket")
        return df.groupBy(bucket).agg(F.count("*").alias(f"{side}_rows"), F.bit_xor(F.xxhash64(*m.keys, "row_hash")).alias(f"{side}_sum"))

    both = sums(m.source, "source").join(sums(m.target, "target"), "bucket", "full_outer")
    return both.where("NOT (source_rows <=> target_rows AND source_sum <=> target_sum)")


def key_except(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).subtract(b.select(*keys))


def key_intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def union_changes(changes: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """Change sets of several tables in one schema: table_name, op, primary_key and data as JSON, digests."""
    parts = [df.select(F.lit(t).alias("table_name"), "op", F.to_json(F.struct(*keys[t])).alias("primary_key"), "source_hash", "target_hash", F.to_json("source_data").alias("source_data"), F.to_json("target_data").alias("target_data")) for t, df in changes.items()]
    return reduce(DataFrame.unionByName, parts)


def reverse(changes: DataFrame) -> DataFrame:
    """The change set the other way round."""
    op = F.when(F.col("op") == "INSERT", "DELETE").when(F.col("op") == "DELETE", "INSERT").otherwise(F.col("op"))
    return changes.withColumns({"op": op, "source_hash": F.col("target_hash"), "target_hash": F.col("source_hash"), "source_data": F.col("target_data"), "target_data": F.col("source_data")})


def apply_changes(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`table` after the change set, which is computed once: rows of deleted and updated keys go, inserted and updated rows come."""
    changes = once(changes)
    gone = small(changes.where("op <> 'INSERT'").select(*keys)).alias("t")
    kept = table.alias("s").join(gone, same_key(keys), "left_anti")
    new = changes.where("op <> 'DELETE'").select("source_data.*")
    return kept.select(*new.columns).unionByName(new)
