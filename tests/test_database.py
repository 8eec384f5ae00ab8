"""Even reads from a database, and statements applied exactly once."""

import sqlite3
import threading

import pytest

from rowmend.operators import diff
from rowmend.sources import database
from rowmend.spec import TableSpec


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    return f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db;create=true"


OVER = {"numbering": "ROW_NUMBER() OVER ()"}  # Derby numbers an ordered derived table


def put(df, url, name, mode="overwrite"):
    texts = ", ".join(f"{n.upper()} VARCHAR(64)" for n, kind in df.dtypes if kind == "string")
    named = df.toDF(*[c.upper() for c in df.columns]).write.format("jdbc").options(url=url, dbtable=name)
    (named.option("createTableColumnTypes", texts) if texts else named).mode(mode).save()


@pytest.mark.parametrize("name,keys,sql", [
    ("skewed", ["k"], "select cast(if(id < 4000, id * id * 1000, id) as long) as k, id as v from range(5000)"),
    ("composite", ["a", "b"], "select cast(if(id < 4000, 7, id) as int) as a, cast(id % 3000 as int) as b, cast(id as string) as v from range(5000)"),
    ("texts", ["name"], "select concat(if(id % 9 = 0, 'O''Brien ', 'z'), cast(id as string)) as name, id as v from range(5000)"),
])
def test_even_partitions_of_any_keys(spark, url, name, keys, sql):
    rows = spark.sql(sql).dropDuplicates(keys)
    put(rows, url, name)
    plan = database.plan_reading(spark, url, name, keys, rows=600, **OVER)
    back = database.read_ranges(spark, url, plan)
    sizes = back.rdd.glom().map(len).collect()
    n = rows.count()
    assert len(sizes) == -(-n // 600) + 1 and sizes[-1] == 0  # the range of null keys
    assert all(s == 600 for s in sizes[:-2]) and sum(sizes) == n
    renamed = back.toDF(*[c.lower() for c in back.columns])
    assert diff.diff(rows, renamed, TableSpec(name, tuple(keys))).isEmpty()


def test_null_keys_filters_and_columns(spark, url):
    put(spark.createDataFrame([(None, 1, "x"), (2, None, "y"), (None, None, "z")] + [(i, i, "w") for i in range(50)], "a int, b int, c string"), url, "nulls")
    plan = database.plan_reading(spark, url, "nulls", ["a", "b"], rows=20, where="c <> 'z'", columns=["a", "c"], **OVER)
    back = database.read_ranges(spark, url, plan)
    assert [c.upper() for c in back.columns] == ["A", "C"]
    assert back.rdd.glom().map(len).collect() == [20, 20, 10, 2]
    plain = database.plan_reading(spark, url, "nulls", ["a"], rows=1000, not_null=True, **OVER)
    assert plain.predicates == ["1 = 1"]


def test_one_snapshot_for_all_partitions(spark, url):
    put(spark.range(100).selectExpr("cast(id as int) as k", "1 as version"), url, "versioned")
    plan = database.plan_reading(spark, url, "versioned", ["k"], rows=30, point_query="SELECT MAX(version) AS p FROM versioned", at_point="(SELECT * FROM {table} WHERE version <= {point}) s", **OVER)
    assert plan.point == 1 and len(plan.predicates) == 5
    put(spark.range(100, 150).selectExpr("cast(id as int) as k", "2 as version"), url, "versioned", "append")
    assert database.read_ranges(spark, url, plan).count() == 100
    loose = database.plan_reading(spark, url, "versioned", ["k"], rows=30, **OVER)
    assert database.read_ranges(spark, url, loose).count() == 150


def test_standard_numbering_is_asked_for(spark):
    """Other databases number by the keys; the text alone, as Derby can't run it."""
    assert database.range_predicates(["a", "b"], [(1, "x'y")], not_null=True) == ["(a < 1 OR (a = 1 AND b < 'x''y')) AND a <= 1", "(a > 1 OR (a = 1 AND b >= 'x''y')) AND a >= 1"]


# ---------------------------------------------------------------- exactly once


@pytest.fixture
def store(tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as c:
        c.execute("create table t (k integer primary key, n integer)")
        c.executemany("insert into t values (?, 0)", [(i,) for i in range(200)])
    connect = lambda: sqlite3.connect(path, timeout=30)
    database.create_ledger(connect)
    return path, connect


def counts(path):
    with sqlite3.connect(path) as c:
        return dict(c.execute("select n, count(*) from t group by n").fetchall())


def updates(spark, n=200):
    return spark.range(n).selectExpr("concat('update t set n = n + 1 where k = ', id, ';') as statement")


def breaking():
    """Makes connections that fail; in a function, so that tasks can unpickle them."""

    def make(inner, after):
        class Breaking:
            """A connection whose cursor fails after some statements."""

            def __init__(self, inner, after):
                self.inner, self.left = inner, after

            def __getattr__(self, name):
                return getattr(self.inner, name)

            def cursor(self):
                cursor, outer = self.inner.cursor(), self

                class Cursor:
                    rowcount = property(lambda _: cursor.rowcount)

                    def fetchone(self):
                        return cursor.fetchone()

                    def execute(self, text):
                        if text.startswith("update"):
                            outer.left -= 1
                            if outer.left < 0:
                                raise OSError("connection lost")
                        return cursor.execute(text)

                return Cursor()

        return Breaking(inner, after)

    return make


def test_a_failed_run_goes_on_where_it_stopped(spark, store):
    (path, connect), make = store, breaking()
    with pytest.raises(Exception, match="connection lost"):
        database.apply_once(updates(spark), lambda: make(connect(), 33), "run-1", batch=10, parts=3)
    some = counts(path)
    assert set(some) == {0, 1} and 0 < some[1] < 200  # whole batches, none in part
    done = database.apply_once(updates(spark), connect, "run-1", batch=10, parts=3)
    assert counts(path) == {1: 200}
    rows = done.collect()
    assert sum(r.statements for r in rows) == sum(r.affected for r in rows) == 200 and sum(r.statements for r in rows if r.applied_before) == some[1]
    again = database.apply_once(updates(spark).repartition(7), connect, "run-1", batch=10, parts=3)
    assert counts(path) == {1: 200} and again.where("not applied_before").isEmpty()
    with pytest.raises(Exception, match="other statements"):
        database.apply_once(updates(spark, 190), connect, "run-1", batch=10, parts=3)
    database.apply_once(updates(spark), connect, "run-2", batch=10, parts=3)
    assert counts(path) == {2: 200}


def test_two_tasks_with_one_batch(store):
    path, connect = store
    texts, out = [f"update t set n = n + 1 where k = {i}" for i in range(50)], []

    def task():
        connection = connect()
        out.append(database.apply_batch(connection, "r", 0, 0, texts, "applied_batches"))
        connection.close()

    threads = [threading.Thread(target=task) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert counts(path) == {0: 150, 1: 50} and sorted(out) == [(50, 50, False)] + [(50, 50, True)] * 5


def test_deletes_inserts_updates_in_order(spark, store):
    path, connect = store
    rows = [(1, f"insert into t values ({i}, 5)") for i in range(10)] + [(0, f"delete from t where k = {i}") for i in range(10)] + [(2, f"update t set n = 9 where k = {i}") for i in range(10)]
    made = spark.createDataFrame(rows * 1, "op_rank int, statement string")
    assert database.apply_once(made, connect, "r", batch=3, parts=2).count() >= 12
    assert counts(path) == {0: 190, 9: 10}
    assert database.apply_once(made.limit(0), connect, "none").isEmpty()
    with pytest.raises(ValueError, match="run id"):
        database.apply_once(made, connect, "a'b")
