"""Type names of database vendors, their standardised types and categories, and those of Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Vendor type names by standardised type.
VENDOR_NAMES = {
    "integer": ["int", "integer", "bigint", "smallint"],
    "numeric": ["number", "numeric"],
    "decimal": ["decimal"],
    "float": ["float", "double", "double_precision", "binary_float", "binary_double"],
    "varchar": ["varchar", "varchar2"],
    "char": ["char"],
    "nchar": ["nchar"],
    "nvarchar": ["nvarchar", "nvarchar2"],
    "text": ["text"],
    "clob": ["clob"],
    "nclob": ["nclob"],
    "long_text": ["long"],
    "date": ["date"],
    "timestamp": ["timestamp"],
    "datetime": ["datetime"],
    "timestamp_tz": ["timestamp_with_time_zone"],
    "timestamp_ltz": ["timestamp_with_local_time_zone"],
    "time": ["time"],
    "blob": ["blob"],
    "binary": ["binary", "raw"],
    "varbinary": ["varbinary"],
    "long_binary": ["long_raw"],
    "bfile": ["bfile"],
    "interval_ym": ["interval_year_to_month"],
    "interval_ds": ["interval_day_to_second"],
    "boolean": ["boolean"],
    "json": ["json"],
    "xml": ["xmltype"],
    "rowid": ["rowid"],
    "urowid": ["urowid"],
}
# Standardised types by category.
CATEGORIES = {
    "numeric": ["integer", "numeric", "decimal", "float"],
    "character": ["varchar", "char", "nchar", "nvarchar", "text", "clob", "nclob", "long_text"],
    "datetime": ["date", "timestamp", "datetime", "timestamp_tz", "timestamp_ltz", "time"],
    "binary": ["blob", "binary", "varbinary", "long_binary", "bfile"],
    "interval": ["interval_ym", "interval_ds"],
    "special": ["boolean", "json", "xml", "rowid", "urowid"],
}
STANDARD = {v: k for k, names in VENDOR_NAMES.items() for v in names}
CATEGORY = {v: k for k, names in CATEGORIES.items() for v in names}


def standard_type(vendor: str | None) -> str:
    """Standardised type of a vendor's type name; lengths and precisions anywhere in it don't matter."""
    plain = re.sub(r"\([^)]*\)", " ", (vendor or "").lower())
    return STANDARD.get("_".join(plain.split()), "unknown")


def category(standard: str) -> str:
    return CATEGORY.get(standard, "unknown")


def spark_standard(kind: T.DataType, tag: str | None = None) -> str:
    """Standardised type of a Spark type; a tag refines it."""
    if tag in CATEGORY:
        return tag
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, T.FractionalType):
        return "float"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "varchar"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, T.TimestampNTZType):
        return "timestamp"
    if isinstance(kind, T.TimestampType):
        return "timestamp_tz"
    if isinstance(kind, T.BinaryType):
        return "binary"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.YearMonthIntervalType):
        return "interval_ym"
    if isinstance(kind, T.DayTimeIntervalType):
        return "interval_ds"
    return "unknown"


def common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """Type in which values of two types of one category compare; None if the categories differ or no type holds both (then as text)."""
    if a == b:
        return a
    kinds = category(spark_standard(a)), category(spark_standard(b))
    if kinds[0] != kinds[1] or "unknown" in kinds:
        return None
    if kinds[0] == "numeric":
        if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
            return T.LongType()
        if any(isinstance(x, (T.FloatType, T.DoubleType)) for x in (a, b)):
            return T.DoubleType()
        scale = max(x.scale if isinstance(x, T.DecimalType) else 0 for x in (a, b))
        whole = max(x.precision - x.scale if isinstance(x, T.DecimalType) else 19 for x in (a, b))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else None
    if kinds[0] == "datetime":
        return T.TimestampType() if any(isinstance(x, T.TimestampType) for x in (a, b)) else T.TimestampNTZType()
    return T.StringType() if kinds[0] == "character" else None
