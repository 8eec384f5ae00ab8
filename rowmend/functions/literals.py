"""SQL literals and identifiers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.functions.normalize import base64_text, flag_text, json_text


def quoted(c: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix + "'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def literal(c: Column, kind: T.DataType, tag: str | None = None, dialect: str = "oracle") -> Column:
    """SQL literal of a value; null is NULL."""
    oracle = dialect == "oracle"
    if tag == "json":
        text = quoted(json_text(c.cast("string")))
    elif tag in ("flag", "boolean") or isinstance(kind, T.BooleanType):
        truth = flag_text(c) == "true"
        text = F.when(truth, "1" if oracle else "TRUE").when(c.isNotNull(), "0" if oracle else "FALSE")
    elif isinstance(kind, T.NumericType):
        text = c.cast("string")
    elif isinstance(kind, T.DateType):
        text = F.concat(F.lit("DATE '" if oracle else "'"), F.date_format(c, "yyyy-MM-dd"), F.lit("'"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.lit("TIMESTAMP '" if oracle else "'"), F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("'"))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("HEXTORAW('"), F.hex(c), F.lit("')")) if oracle else F.concat(F.lit("'"), base64_text(c), F.lit("'"))
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = quoted(F.to_json(c))
    else:
        text = quoted(c.cast("string"), "N" if oracle and tag in ("nchar", "nvarchar", "nclob") else "")
    return F.coalesce(text, F.lit("NULL"))


def identifier(name: str) -> str:
    """Upper case if plain, else in double quotes."""
    return name.upper() if re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", name) else '"' + name.replace('"', '""') + '"'
