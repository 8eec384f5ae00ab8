import pytest
from pyspark.sql import functions as F

from rowmend.operators import checks, diff, paging, report, sqlgen, stats, verify
from rowmend.operators.columns import DuplicateKeyError, MissingKeyError, align, require_unique
from rowmend.plans import run
from rowmend.sources import io
from rowmend.spec import TableSpec

SCHEMA = "k long, a string, n double"
SPEC = TableSpec("t", ("k",))


def frames(spark):
    s = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, None, 3.0), (4, "O'Brien", 4.0), (None, "null key", 0.0)], SCHEMA)
    t = spark.createDataFrame([(2, "y", 2.0), (3, "NULL", 3.0), (4, "O'Brien", float("nan")), (9, "gone", 9.0), (None, "null key", 1.0)], SCHEMA)
    return s, t


def ops(df):
    return sorted((r["op"], r["k"] if r["k"] is not None else -1) for r in df.collect())


def test_diff_and_parts(spark):
    s, t = frames(spark)
    d = diff.diff(s, t, SPEC)
    assert ops(d) == [("DELETE", 9), ("INSERT", 1), ("UPDATE", -1), ("UPDATE", 3), ("UPDATE", 4)]
    assert ops(diff.thin_diff(s, t, SPEC)) == ops(d)
    assert [r.k for r in diff.inserts(s, t, SPEC).collect()] == [1]
    assert [r.k for r in diff.deletes(s, t, SPEC).collect()] == [9]
    assert diff.updates(s, t, SPEC).count() == 3
    assert diff.diff(s, s, SPEC).isEmpty()


def test_invariants(spark):
    s, t = frames(spark)
    d = diff.diff(s, t, SPEC)
    assert diff.diff(s, diff.apply_changes(t, d, ["k"]), SPEC).isEmpty()
    assert diff.diff(t, diff.apply_changes(s, diff.reverse(d), ["k"]), SPEC).isEmpty()
    assert ops(diff.reverse(d)) == ops(diff.diff(t, s, SPEC))
    row = stats.statistics(diff.classify(align(s, t, SPEC))).first()
    assert (row.source_row_count, row.target_row_count, row.total_differences) == (5, 5, 5)
    assert row.match_percentage == 0.0
    checked = verify.verify(d, t, ["k"])
    assert verify.valid(checked).count() == 5
    after = verify.verify(d, diff.apply_changes(t, d, ["k"]), ["k"])
    assert verify.valid(after.where("op <> 'UPDATE'")).isEmpty()
    assert diff.diff(s.repartition(7), t.coalesce(1), SPEC).select("op", "k").exceptAll(d.select("op", "k")).isEmpty()


def test_empty_and_disjoint(spark):
    s, t = frames(spark)
    none = s.limit(0)
    row = stats.statistics(diff.classify(align(none, none, SPEC))).first()
    assert row.total_differences == 0 and row.match_percentage == 0
    other = t.withColumn("k", F.lit(100) + F.monotonically_increasing_id())
    row = stats.statistics(diff.classify(align(s, other, SPEC))).first()
    assert row.match_percentage < 0 and row.match_percentage_clamped == 0


def test_names_types_and_order(spark):
    s, _ = frames(spark)
    t = s.select(F.col("n").alias("N"), F.col("a").alias("A"), F.col("k").cast("decimal(20,2)").alias("K"), F.lit(1).alias("extra"))
    assert diff.diff(s, t, SPEC).isEmpty()
    verdicts = {r.column_name: r.verdict for r in checks.schema_compatibility(s, t).collect()}
    assert verdicts == {"k": "warning", "a": "compatible", "n": "compatible", "extra": "warning"}
    with pytest.raises(MissingKeyError):
        diff.diff(s, t, TableSpec("t", ("zz",)))


def test_duplicates(spark):
    s, t = frames(spark)
    twice = s.unionByName(s.where("k = 1").withColumn("a", F.lit("other")))
    with pytest.raises(DuplicateKeyError):
        require_unique(twice, ["k"])
    with pytest.raises(Exception, match='key \\{"k":1\\} is not unique'):
        diff.diff(twice, t, SPEC).collect()
    with pytest.raises(Exception, match="is not unique"):
        diff.inserts(t, s.unionByName(s.where("k is null")), SPEC).collect()
    assert ("INSERT", 1) not in ops(diff.diff(twice, t, TableSpec("t", ("k",), duplicates="exclude")))
    assert ops(diff.diff(twice, t, TableSpec("t", ("k",), duplicates="first"))).count(("INSERT", 1)) == 1


def test_long_strings_fail_verification(spark):
    s = spark.createDataFrame([(1, "x" * 4001), (2, "x" * 4000)], "k long, a string")
    d = diff.diff(s, s.limit(0), SPEC)
    got = {r.k: r.verification_reason for r in verify.verify(d, s.limit(0), ["k"]).collect()}
    assert got == {1: verify.LENGTH, 2: verify.ABSENT}


def test_statements(spark, tmp_path):
    s, t = frames(spark)
    made = sqlgen.statements(diff.diff(s, t, SPEC), SPEC)
    texts = [r.statement for r in sqlgen.ordered(made, ["k"]).collect()]
    assert texts[0] == "DELETE FROM MAIN.T WHERE K = 9;"
    assert texts[1] == "INSERT INTO MAIN.T (K, A, N) VALUES (1, 'x', 1.0);"
    assert any("WHERE K IS NULL" in x for x in texts) and any("'O''Brien'" in x for x in texts)
    io.write_scripts(made, str(tmp_path / "sql"), ["k"])
    assert spark.read.text(str(tmp_path / "sql")).count() == len(texts)


def test_reports(spark, tmp_path):
    s, t = frames(spark)
    d = diff.diff(s, t, SPEC)
    changed = {(r.k, r.column_name): (r.old_value, r.new_value) for r in report.changed_columns(d, ["k"]).collect()}
    assert changed == {(3, "a"): ("NULL", None), (4, "n"): ("nan", "4"), (None, "n"): ("1", "0")}
    assert report.samples(d, ["k"], 1).count() == 3
    summary = run.compare_tables(spark, [(SPEC, lambda: s, lambda: t), (TableSpec("bad", ("zz",)), lambda: s, lambda: t)])
    assert {r.table_name: r.status for r in summary.collect()} == {"t": "SUCCESS", "bad": "ERROR"}
    io.write_csv(report.csv_summary(summary), str(tmp_path / "csv"))
    assert len(spark.read.option("header", True).csv(str(tmp_path / "csv")).columns) == 13
    io.write_json(report.json_report(summary, "r1"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_events_skip_malformed(spark, tmp_path):
    spark.createDataFrame([('{"timestamp":"2024-01-01T00:00:00","session_id":"s","event_type":"ERROR","message":"m","details":"{}"}',), ("not json",)], "value string").write.text(str(tmp_path / "log"))
    assert [r.event_type for r in io.read_events(spark, str(tmp_path / "log")).collect()] == ["ERROR"]


def test_plans(spark):
    s, t = frames(spark)
    plan = diff.diff(s, t, TableSpec("t", ("k",), duplicates="exclude"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SinglePartition" not in plan
    numbered = paging.with_row_number(spark.range(1000).withColumnRenamed("id", "k").repartition(5), ["k"])
    assert numbered.where("rn <> k + 1").isEmpty() and paging.page(s, ["k"], 1, 2).count() == 2


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    s, _ = frames(spark)
    s.where("k is not null").select("k", "n").write.format("jdbc").options(url=url, dbtable="t1").save()
    back = io.read_table(spark, url, "jdbc", dbtable="t1", partitionColumn="k", lowerBound=1, upperBound=4, numPartitions=2)
    assert diff.diff(s.where("k is not null").select("k", "n"), back, SPEC).isEmpty()


def test_stream_counts_like_batch(spark, tmp_path):
    from rowmend.streaming import audit as live

    rows = [(f"2024-01-01T00:{m:02d}:00", "s", "ERROR" if m % 2 else "WARNING", "m", 1, "{}") for m in range(30)]
    spark.createDataFrame(rows, "timestamp string, session_id string, event_type string, message string, thread_id long, details string").write.json(str(tmp_path / "in"))
    q = live.windowed_counts(live.event_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("live_counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) from live_counts").first()[0] == 30


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan"), plan.count("LocalTableScan")


def test_change_sets_are_computed_once(spark, tmp_path):
    spark.range(2000).selectExpr("id", "id % 7 as v", "cast(id as string) as s").write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    b = a.where("id % 50 <> 3").withColumn("v", F.when(F.col("id") % 90 == 5, F.col("v") + 1).otherwise(F.col("v")))
    spec = TableSpec("a", ("id",), duplicates="unique")
    changed = diff.diff(a, b, spec)
    assert scans(changed)[0] == 2
    verified = verify.verify(changed, b, ["id"])
    assert scans(verified)[0] == 1  # the current side alone: the change set is kept
    assert verified.where("verification_status = 'INVALID'").isEmpty() and verified.count() == changed.count()
    applied = diff.apply_changes(b, changed, ["id"])
    assert scans(applied)[0] == 1 and applied.select(*a.columns).exceptAll(a).isEmpty() and applied.count() == 2000
    thin = diff.thin_diff(a, b, spec)
    assert scans(thin)[0] == 2 and thin.select(*changed.columns).exceptAll(changed).isEmpty()


def test_decimals_without_a_common_type(spark):
    a = spark.sql("select 1 as k, cast('99999999999999999999999999999999999999' as decimal(38,0)) as v union all select 2, cast(5 as decimal(38,0))")
    b = spark.sql("select 1 as k, cast('1.5' as decimal(38,10)) as v union all select 2, cast(5 as decimal(38,10))")
    got = {r.k: r.op for r in diff.diff(a, b, TableSpec("d", ("k",))).collect()}
    assert got == {1: "UPDATE"}


def test_statements_go_in_batches(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as c:
        c.execute("create table t (k integer primary key)")
    rows = [(f"insert into t values ({i});",) for i in range(10)] + [("insert into t values (3);",)]
    made = spark.createDataFrame(rows, "statement string").coalesce(1)
    io.apply_to_database(made.limit(10), lambda: sqlite3.connect(path), 4)
    with sqlite3.connect(path) as c:
        assert c.execute("select count(*) from t").fetchone() == (10,)
        c.execute("delete from t")
    with pytest.raises(Exception):  # noqa: B017, PT011  the third batch fails, the two before it stay
        io.apply_to_database(made, lambda: sqlite3.connect(path), 4)
    with sqlite3.connect(path) as c:
        assert c.execute("select count(*) from t").fetchone() == (8,)


def test_reports_are_written(spark, tmp_path):
    a = spark.range(30).selectExpr("id as k", "id as v")
    b = a.where("k <> 4").withColumn("v", F.when(F.col("k") == 7, 0).otherwise(F.col("v")))
    spec = TableSpec("a", ("k",))
    summaries = run.compare_table(a, b, spec)
    run.write_reports(run.reports({"a": diff.diff(a, b, spec)}, summaries, {"a": ["k"]}, "r1"), str(tmp_path))
    assert len(spark.read.option("header", True).csv(f"{tmp_path}/summary_csv").columns) == 13
    assert spark.read.json(f"{tmp_path}/changed_columns").first()["column_name"] == "v"
    assert [r.event_type for r in run.run_events(summaries, "r1").collect()] == ["SESSION_START", "TABLE_COMPLETE", "SESSION_END"]
    io.append_events(run.run_events(summaries, "r1"), f"{tmp_path}/events")
    assert io.read_events(spark, f"{tmp_path}/events").count() == 3
