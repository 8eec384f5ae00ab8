"""Look-ups in catalogs and dictionary views, and normal forms of rare types."""

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.functions.normalize import normalize
from rowmend.operators.checks import table_exists
from rowmend.sources import io


def test_table_exists(spark):
    spark.range(3).createOrReplaceTempView("there_is")
    assert table_exists(spark, "there_is") and table_exists(spark, "THERE_IS") and not table_exists(spark, "there_is_not")


def test_tables_and_keys_of_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.format("jdbc").options(url=url, dbtable=name).save()

    put("all_tables", [("MAIN", "ORDERS"), ("Main", "Lines")], "OWNER string, TABLE_NAME string")
    assert io.jdbc_table_exists(spark, url, "all_tables", "main", "orders") and io.jdbc_table_exists(spark, url, "all_tables", "MAIN", "LINES")
    assert not io.jdbc_table_exists(spark, url, "all_tables", "other", "orders") and not io.jdbc_table_exists(spark, url, "all_tables", "main", "order")
    constraints = spark.createDataFrame([("M", "c1", "P"), ("M", "c2", "R"), ("N", "c1", "P")], "owner string, constraint_name string, constraint_type string")
    columns = spark.createDataFrame([("M", "c1", "T", "b", 2), ("M", "c1", "T", "a", 1), ("M", "c2", "T", "x", 1), ("N", "c1", "U", "k", 1)], "owner string, constraint_name string, table_name string, column_name string, position int")
    assert [(r.owner, r.table_name, r.column_name, r.position) for r in io.primary_keys(constraints, columns).collect()] == [("M", "T", "a", 1), ("M", "T", "b", 2), ("N", "U", "k", 1)]
    found = io.metadata(columns.select("owner", "table_name", "column_name"), io.primary_keys(constraints, columns))
    assert {r.column_name: r.key_position for r in found.collect()} == {"a": 1, "b": 2, "x": None, "k": 1}


def test_intervals_and_xml(spark):
    df = spark.createDataFrame([(datetime.timedelta(days=1, seconds=3.5), "<a/>"), (None, None)], "d interval day to second, x string")
    got = df.select(normalize(F.col("d"), T.DayTimeIntervalType()).alias("d"), normalize(F.col("x"), T.StringType(), "xml").alias("x")).collect()
    assert [tuple(r) for r in got] == [("INTERVAL '1 00:00:03.5' DAY TO SECOND", "<a/>"), (None, None)]


def test_events_keep_microseconds(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2024-01-01 00:00:07.179575' as timestamp, 's' as session_id, 'ERROR' as event_type, 'm' as message, 1L as thread_id, '{}' as details")
    io.append_events(rows, str(tmp_path / "e"))
    assert io.read_events(spark, str(tmp_path / "e")).first()["timestamp"] == datetime.datetime(2024, 1, 1, 0, 0, 7, 179575)
