import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.functions.digest import digest, row_text
from rowmend.functions.literals import identifier, literal
from rowmend.functions.normalize import date_string_text, normalize, typed_equal
from rowmend.functions.types import category, common_type, standard_type


def one(spark, value, kind, fn):
    return spark.createDataFrame([(value,)], T.StructType([T.StructField("x", kind)])).select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "kind,value,tag,want",
    [
        (T.LongType(), 2**53 + 1, None, "9007199254740993"),
        (T.DoubleType(), 0.1 + 0.2, None, "0.3"),
        (T.DoubleType(), 100.0, None, "100"),
        (T.DoubleType(), 1e20, None, "1e+20"),
        (T.DoubleType(), -0.0, None, "0"),
        (T.DoubleType(), float("nan"), None, "nan"),
        (T.DecimalType(18, 4), decimal.Decimal("1.5000"), None, "1.5"),
        (T.DecimalType(18, 4), decimal.Decimal("1200"), None, "1200"),
        (T.DecimalType(18, 0), decimal.Decimal("100"), None, "100"),
        (T.StringType(), "a\r\nb\rc\nd", "clob", "a\nb\nc\nd"),
        (T.StringType(), '{"b": 1, "a": [1, 2]}', "json", '{"a":[1,2],"b":1}'),
        (T.StringType(), "{bad", "json", "{bad"),
        (T.StringType(), "Y", "flag", "true"),
        (T.StringType(), "0", "flag", "false"),
        (T.BooleanType(), True, None, "true"),
        (T.BinaryType(), bytearray(b"\x00" * 100), None, "A" * 134 + "=="),
        (T.DateType(), dt.date(2024, 1, 2), None, "2024-01-02"),
        (T.TimestampNTZType(), dt.datetime(2024, 1, 2, 3, 4, 5, 6), None, "2024-01-02 03:04:05.000006"),
        (T.StringType(), None, None, None),
    ],
)
def test_normal_form(spark, kind, value, tag, want):
    assert one(spark, value, kind, lambda c: normalize(c, kind, tag)) == want


@pytest.mark.parametrize("text", ["2024-01-02", "2024-01-02 00:00:00", "2024-01-02 00:00:00.000000", "02-Jan-2024", "02-JAN-2024 00:00:00", "1/2/2024", "01/02/2024 00:00:00"])
def test_date_strings(spark, text):
    assert one(spark, text, T.StringType(), date_string_text) == "2024-01-02"
    assert one(spark, "soon", T.StringType(), date_string_text) == "soon"


def test_null_is_not_the_word_null(spark):
    df = spark.createDataFrame([(None, "NULL"), ("a|b:c", "a"), (None, None)], "a string, b string")
    equal = df.select(typed_equal(F.col("a"), F.col("b"), T.StringType()).alias("e"))
    assert [r.e for r in equal.collect()] == [False, False, True]
    forms = [("a", F.col("a")), ("b", F.col("b"))]
    safe = df.unionByName(spark.createDataFrame([("NULL", "NULL")], "a string, b string")).select(digest(row_text(forms)).alias("h"), digest(row_text(forms, "compat"), "md5").alias("c")).collect()
    assert len({r.h for r in safe}) == 4
    assert safe[2].c == safe[3].c  # the compatible encoding can't tell them apart


def test_literals(spark):
    s = T.StringType()
    assert one(spark, "O'Brien", s, lambda c: literal(c, s)) == "'O''Brien'"
    assert one(spark, None, s, lambda c: literal(c, s)) == "NULL"
    assert one(spark, "x", s, lambda c: literal(c, s, "nvarchar")) == "N'x'"
    assert one(spark, bytearray(b"\x00\xff\x10"), T.BinaryType(), lambda c: literal(c, T.BinaryType())) == "HEXTORAW('00FF10')"
    assert one(spark, True, T.BooleanType(), lambda c: literal(c, T.BooleanType())) == "1"
    assert one(spark, True, T.BooleanType(), lambda c: literal(c, T.BooleanType(), dialect="other")) == "TRUE"
    assert one(spark, dt.date(2024, 1, 2), T.DateType(), lambda c: literal(c, T.DateType())) == "DATE '2024-01-02'"
    assert identifier("abc_1") == "ABC_1" and identifier("a b") == '"a b"'


def test_types():
    assert standard_type("TIMESTAMP(6) WITH TIME ZONE") == "timestamp_tz"
    assert standard_type("INTERVAL DAY(2) TO SECOND(6)") == "interval_ds"
    assert standard_type("NUMBER(10,2)") == "numeric" and category("numeric") == "numeric"
    assert standard_type("made_up") == "unknown" and category("unknown") == "unknown"
    assert common_type(T.LongType(), T.DecimalType(10, 2)) == T.DecimalType(21, 2)
    assert common_type(T.StringType(), T.DateType()) is None
