"""Statistics of tables from one pass: exact counts and ends, and sketches that merge.

`sketches` leaves one row (or one for each value of `by`, say a day): `rows`, and for each column a struct of `nulls`, `lo`,
`hi`, `distinct` (a HyperLogLog sketch) and, for numbers, `spread` (a KLL sketch of quantiles). Rows of several days, files or
sides merge without reading the data again; `described` turns them into one row a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.functions.normalize import normalize
from rowmend.functions.types import spark_standard
from rowmend.operators.checks import schema_compatibility
from rowmend.operators.columns import find

#: Size of the HyperLogLog sketches (2^12 registers: about 1.6 % standard error) and of the KLL sketches (about 1.3 % of rank).
LOG_REGISTERS, SPREAD = 12, 200


def _ordered(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType, T.StructType, T.ArrayType))


def sketches(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    out = [F.count("*").alias("rows")]
    for f in df.schema:
        if f.name in by:
            continue
        c = F.col(f"`{f.name}`")
        text = normalize(c, f.dataType)
        parts = [F.count_if(c.isNull()).alias("nulls"), (F.min(c) if _ordered(f.dataType) else F.min(text)).alias("lo"), (F.max(c) if _ordered(f.dataType) else F.max(text)).alias("hi"), F.hll_sketch_agg(text, F.lit(LOG_REGISTERS)).alias("distinct")]
        if isinstance(f.dataType, T.NumericType):
            parts.append(F.kll_sketch_agg_double(c.cast("double"), F.lit(SPREAD)).alias("spread"))
        out.append(F.struct(*parts).alias(f.name))
    return df.groupBy(*by).agg(*out)


def merged(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `sketches` merged into one, or one for each value of `by`."""
    out = [F.sum("rows").alias("rows")]
    for f in parts.schema:
        if isinstance(f.dataType, T.StructType) and {"nulls", "distinct"} <= set(f.dataType.names):
            c = f"`{f.name}`"
            made = [F.sum(f"{c}.nulls").alias("nulls"), F.min(f"{c}.lo").alias("lo"), F.max(f"{c}.hi").alias("hi"), F.hll_union_agg(f"{c}.distinct").alias("distinct")]
            if "spread" in f.dataType.names:
                made.append(F.kll_merge_agg_double(f"{c}.spread").alias("spread"))
            out.append(F.struct(*made).alias(f.name))
    return parts.groupBy(*by).agg(*out)


def described(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, position, column_name, rows, nulls, lo, hi, distinct_estimate, quartiles) with lo and hi in normal form."""
    each, place = [], 0
    for f in parts.schema:
        if not (isinstance(f.dataType, T.StructType) and {"nulls", "distinct"} <= set(f.dataType.names)):
            continue
        c = F.col(f"`{f.name}`")
        kinds = {x.name: x.dataType for x in f.dataType}
        quartiles = F.array(*[F.kll_sketch_get_quantile_double(c["spread"], F.lit(q)) for q in (0.25, 0.5, 0.75)]) if "spread" in kinds else F.lit(None).cast("array<double>")
        some = F.col("rows") > c["nulls"]
        each.append(F.struct(F.lit(place).alias("position"), F.lit(f.name).alias("column_name"), F.col("rows").alias("rows"), c["nulls"].alias("nulls"), normalize(c["lo"], kinds["lo"]).alias("lo"), normalize(c["hi"], kinds["hi"]).alias("hi"), F.hll_sketch_estimate(c["distinct"]).alias("distinct_estimate"), F.when(some, quartiles).alias("quartiles")))
        place += 1
    return parts.select(*by, F.inline(F.array(*each)))


def table_profile(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """`described` with each column's Spark type, standardised type, nullability and place in the key."""
    places = {find(df, k): i for i, k in enumerate(keys)}
    known = F.create_map(*[x for f in df.schema for x in (F.lit(f.name), F.struct(F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(spark_standard(f.dataType)).alias("standard_type"), F.lit(f.nullable).alias("nullable"), F.lit(places.get(f.name)).cast("int").alias("key_position")))])
    out = described(sketches(df))
    return out.select("*", known[F.col("column_name")].alias("_known")).select(*out.columns, "_known.*")


def misfit_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """(column_name, source_values, target_values, misfits): values that aren't null, and the source's that the target's type can't hold."""

    def longest(kind: T.DataType) -> int | None:
        return kind.length if isinstance(kind, (T.VarcharType, T.CharType)) else None

    def values(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
        each: list[Column] = []
        for c in df.columns:
            o = find(other, c)
            bad = F.lit(0).cast("long")
            if o is not None:
                kind, limit = other.schema[o].dataType, longest(other.schema[o].dataType)
                held = F.col(f"`{c}`").try_cast(kind.simpleString() if limit is None else "string")
                fits = held.isNotNull() if limit is None else F.length(held) <= limit
                bad = F.count_if(F.col(f"`{c}`").isNotNull() & ~fits)
            each.append(F.struct(F.lit(c.lower()).alias("column_name"), F.count(F.col(f"`{c}`")).alias(f"{name}_values"), bad.alias("misfits")))
        return df.agg(F.array(*each).alias("x")).select(F.inline("x"))

    both = values(source, target, "source").join(values(target, source, "target").drop("misfits"), "column_name", "full_outer")
    return both.select("column_name", F.coalesce("source_values", F.lit(0)).alias("source_values"), F.coalesce("target_values", F.lit(0)).alias("target_values"), F.coalesce("misfits", F.lit(0)).alias("misfits"))


def compatibility(source: DataFrame, target: DataFrame) -> DataFrame:
    """`schema_compatibility` with the figures of `misfit_counts`: what the types say, and what the rows do."""
    return schema_compatibility(source, target).join(misfit_counts(source, target), "column_name")
