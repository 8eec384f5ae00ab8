"""Schema compatibility, type mapping, duplicates, and the declared data checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.functions.types import CATEGORY, STANDARD, spark_standard
from rowmend.operators.columns import duplicate_keys  # noqa: F401  (part of this module's surface)


def schema_table(df: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
    """(position, column_name, data_type, standard_type, nullable) of a DataFrame, from its schema alone."""
    tags = tags or {}
    rows = [(i, f.name, f.dataType.simpleString(), spark_standard(f.dataType, tags.get(f.name)), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string, standard_type string, nullable boolean")


def map_vendor_types(columns: DataFrame) -> DataFrame:
    """`columns` (with data_type) plus standard_type and category, by a broadcast mapping of fixed size."""
    spark = columns.sparkSession
    pairs = spark.createDataFrame([(v, s, CATEGORY[s]) for v, s in STANDARD.items()], "vendor string, standard_type string, category string")
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower("data_type"), r"\([^)]*\)", " ")), r"\s+", "_")
    out = columns.withColumn("vendor", plain).join(F.broadcast(pairs), "vendor", "left").drop("vendor")
    return out.fillna("unknown", ["standard_type", "category"])


def schema_compatibility(source: DataFrame, target: DataFrame) -> DataFrame:
    """(column_name, source_type, target_type, verdict): compatible, warning (same category, or one-sided) or error."""
    a, b = schema_table(source).alias("a"), schema_table(target).alias("b")
    both = a.join(b, F.lower("a.column_name") == F.lower("b.column_name"), "full_outer")
    kinds = F.create_map(*[F.lit(x) for pair in CATEGORY.items() for x in pair])
    x, y = F.col("a.standard_type"), F.col("b.standard_type")
    verdict = F.when(x.isNull() | y.isNull(), "warning").when(x == y, "compatible").when(kinds[x] == kinds[y], "warning").otherwise("error")
    return both.select(F.lower(F.coalesce("a.column_name", "b.column_name")).alias("column_name"), x.alias("source_type"), y.alias("target_type"), verdict.alias("verdict"))


def strings_fit(row: str, schema: T.StructType, limit: int = 4000) -> Column:
    """True where no string in the struct column `row` is longer than `limit`."""
    out = F.lit(True)
    for f in schema:
        if isinstance(f.dataType, T.StringType):
            out = out & F.coalesce(F.length(F.col(f"{row}.`{f.name}`")) <= limit, F.lit(True))
    return out


def orphans(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Child rows whose foreign key isn't null and matches no parent."""
    cond, some = F.lit(True), F.lit(True)
    for c, p in on:
        cond, some = cond & (F.col(f"c.`{c}`") == F.col(f"p.`{p}`")), some & F.col(f"c.`{c}`").isNotNull()
    return child.alias("c").where(some).join(parent.select(*[p for _, p in on]).distinct().alias("p"), cond, "left_anti")


def misfits(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Rows whose value can't be cast to the target type."""
    return df.where(F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull())


def masked(df: DataFrame, columns: list[str], digest: bool = False) -> DataFrame:
    """Listed columns masked, or replaced by their sha256."""
    return df.withColumns({c: F.sha2(F.col(c).cast("string"), 256) if digest else F.mask(F.col(c).cast("string")) for c in columns})


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
