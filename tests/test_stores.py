"""Statistics by sketches, merges into stored tables, the event store, and constraints of change sets."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rowmend.operators import checks, constraints, diff, profile
from rowmend.operators.merge import merge_changes
from rowmend.operators.store import once
from rowmend.plans import run
from rowmend.sources import events
from rowmend.spec import TableSpec

# ---------------------------------------------------------------- statistics


def test_sketches_merge_and_stay_within_bounds(spark):
    df = spark.range(60_000).selectExpr("cast(id as int) as k", "concat('v', id % 20000) as s", "if(id % 10 = 0, null, (id % 1000) / 4.0D) as x", "id % 3 as part", "date'2024-01-01' + cast(id % 40 as int) as d")
    by_part = profile.sketches(df, ("part",))
    assert by_part.count() == 3
    whole = {r.column_name: r for r in profile.described(profile.merged(by_part)).collect()}
    one = {r.column_name: r for r in profile.described(profile.sketches(df.drop("part"))).collect()}
    assert [whole[c].position for c in ("k", "s", "x", "d")] == [0, 1, 2, 3]
    for c, distinct in (("k", 60_000), ("s", 20_000), ("x", 900), ("d", 40)):
        assert (whole[c].rows, whole[c].nulls, whole[c].lo, whole[c].hi) == (one[c].rows, one[c].nulls, one[c].lo, one[c].hi)
        assert abs(whole[c].distinct_estimate - distinct) <= 0.06 * distinct and abs(one[c].distinct_estimate - distinct) <= 0.06 * distinct
    assert (whole["x"].nulls, whole["x"].lo, whole["x"].hi) == (6000, "0.25", "249.75") and whole["d"].hi == "2024-02-09 00:00:00.000000"[: len(whole["d"].hi)]
    for got, want in zip(whole["k"].quartiles, (15_000, 30_000, 45_000), strict=True):
        assert abs(got - want) < 0.03 * 60_000
    assert whole["s"].quartiles is None


def test_profiles_of_odd_tables(spark):
    df = spark.createDataFrame([(None, None, None, {"a": 1}, [1]), (None, None, None, None, None)], "i int, s string, b binary, m map<string,int>, a array<int>")
    rows = {r.column_name: r for r in profile.table_profile(df, ("I",)).collect()}
    assert rows["i"].nulls == 2 and rows["i"].lo is None and rows["i"].quartiles is None and rows["i"].key_position == 0 and rows["m"].nulls == 1
    assert profile.described(profile.sketches(df.limit(0))).where("rows <> 0").isEmpty()
    assert rows["s"].standard_type == "varchar" and rows["s"].key_position is None


def test_compatibility_counts_what_does_not_fit(spark):
    a = spark.createDataFrame([("1", "x", 5), ("2.5", "y", None), ("no", None, 7)], "n string, s string, only_here int")
    b = spark.createDataFrame([(1, "x")], "N int, S string")
    got = {r.column_name: (r.verdict, r.source_values, r.target_values, r.misfits) for r in profile.compatibility(a, b).collect()}
    assert got == {"n": ("error", 3, 1, 2), "s": ("compatible", 2, 1, 0), "only_here": ("warning", 2, 0, 0)}


# ---------------------------------------------------------------- stored tables


def files(path):
    return {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet") for f in [os.path.join(d, n)]}


@pytest.mark.parametrize("kind", ["int", "string", "date"])
def test_merges_rewrite_touched_partitions_only(spark, tmp_path, kind):
    path = f"{tmp_path}/t"
    part = {"int": "cast(id % 10 as int)", "string": "concat('a b/', id % 10)", "date": "date'2024-01-01' + cast(id % 10 as int)"}[kind]
    base = spark.range(1000).selectExpr("id as k", "cast(id as string) as v", f"if(id % 10 = 9, null, {part}) as p")
    base.write.partitionBy("p").parquet(path)
    stored = spark.read.parquet(path)
    moved = F.when(F.col("k") == 44, base.where("k = 5").first()["p"]).otherwise(F.col("p"))
    wanted = stored.where("k % 10 <> 3 and k <> 21").withColumns({"v": F.when(F.col("k") == 12, "new").otherwise(F.col("v")), "p": moved})
    rows = once(wanted.unionByName(stored.where("k = 12").withColumn("k", F.lit(5012).cast("long"))))
    changes = once(diff.diff(rows, stored, TableSpec("t", ("k",))))
    before = files(path)
    done = merge_changes(spark, path, changes, ["k"], "p")
    assert len(done) == 5  # of 1, 2, 3, 4 and 5
    after = files(path)
    still = {f for f in before if after.get(f) == before[f]}
    untouched = {os.path.dirname(f) for f in before} - {os.path.dirname(f) for f in before if f not in still}
    assert len(untouched) == 5 and {os.path.dirname(f) for f in still} == untouched
    now = spark.read.parquet(path)
    assert now.select(*rows.columns).exceptAll(rows).isEmpty() and rows.exceptAll(now.select(*rows.columns)).isEmpty() and now.count() == 900
    assert merge_changes(spark, path, changes, ["k"], "p") and spark.read.parquet(path).count() == 900  # again: the same rows
    assert merge_changes(spark, path, changes.limit(0), ["k"], "p") == []


def test_merge_can_empty_the_null_partition(spark, tmp_path):
    spark.range(20).selectExpr("id as k", "if(id > 9, null, 'x') as p").write.partitionBy("p").parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    changes = once(diff.diff(stored.where("p is not null"), stored, TableSpec("t", ("k",))))
    assert merge_changes(spark, f"{tmp_path}/t", changes, ["k"], "p") == [None]
    assert os.listdir(f"{tmp_path}/t") and spark.read.parquet(f"{tmp_path}/t").count() == 10


# ---------------------------------------------------------------- events


def rows_of(spark, day, n, hour=0):
    return spark.range(n).selectExpr(f"timestamp_ntz'{day} {hour:02d}:00:00' + make_interval(0,0,0,0,0,cast(id as int)) as timestamp", "'s' as session_id", "'ERROR' as event_type", "'m' as message", "id as thread_id", "'{}' as details")


def test_the_event_store_drops_days(spark, tmp_path):
    path = f"{tmp_path}/events"
    assert events.stored_events(spark, path).isEmpty() and events.retain(spark, path, 3, datetime(2024, 3, 9)) == {"dropped": 0, "rewritten": 0}
    for day in ("2024-03-01", "2024-03-02", "2024-03-03", "2024-03-04"):
        events.append_to_store(rows_of(spark, day, 5), path)
    events.append_to_store(rows_of(spark, "2024-03-03", 4, hour=15), path)
    before = files(path)
    assert events.retain(spark, path, 7, datetime(2024, 3, 10, 12)) == {"dropped": 2, "rewritten": 1}
    after = files(path)
    assert {f for f in before if "day=2024-03-04" in f} <= {f for f in after if before.get(f) == after[f]}
    assert not any("2024-03-01" in f or "2024-03-02" in f for f in after)
    left = events.stored_events(spark, path).groupBy("day").count().collect()
    assert {(r["day"], r["count"]) for r in left} == {(date(2024, 3, 3), 4), (date(2024, 3, 4), 5)}
    assert events.retain(spark, path, 7, datetime(2024, 3, 10, 12)) == {"dropped": 0, "rewritten": 0} and files(path) == after
    assert events.retain(spark, path, 0, datetime(2024, 3, 4, 20)) == {"dropped": 1, "rewritten": 1} and events.stored_events(spark, path).isEmpty()


def test_a_run_records_itself(spark, tmp_path):
    a = spark.range(30).selectExpr("id as k", "id as v")
    b = a.where("k <> 4").withColumn("v", F.when(F.col("k") == 7, 0).otherwise(F.col("v")))
    tables = [(TableSpec("a", ("k",)), lambda: a, lambda: b), (TableSpec("bad", ("zz",)), lambda: a, lambda: b)]
    for session in ("r1", "r2"):
        summary = run.recorded_run(spark, tables, str(tmp_path), session)
        assert {r.table_name: (r.status, r.total_differences) for r in summary.collect()} == {"a": ("SUCCESS", 2), "bad": ("ERROR", None)}
    stored = events.stored_events(spark, f"{tmp_path}/events")
    assert {(r.session_id, r.event_type): r["count"] for r in stored.groupBy("session_id", "event_type").count().collect()} == {(s, e): 1 for s in ("r1", "r2") for e in ("SESSION_START", "TABLE_COMPLETE", "ERROR", "SESSION_END")}
    assert spark.read.json(f"{tmp_path}/reports/r1/changed_columns").first()["column_name"] == "v"
    assert spark.read.option("header", True).csv(f"{tmp_path}/reports/r2/summary_csv").count() == 2


# ---------------------------------------------------------------- constraints


def full_check(after, unique):
    return after.where(F.col(unique).isNotNull()).groupBy(unique).agg(F.count("*").alias("n")).where("n > 1")


def test_constraints_of_a_change_set(spark):
    table = spark.range(100).selectExpr("id as k", "concat('u', id) as u", "if(id % 9 = 0, null, id % 20) as f")
    rows = table.where("k not in (5, 6)").withColumn("u", F.expr("case when k = 10 then 'u11' when k = 12 then 'u5' when k = 13 then null when k = 14 then 'u15' when k = 15 then 'u14' else u end"))
    rows = rows.unionByName(spark.createDataFrame([(200, "u50", 3), (201, "new", 77), (202, "new", None), (203, "u5", 4), (204, None, 1), (205, None, 99)], rows.schema))
    changes = once(diff.diff(rows, table, TableSpec("t", ("k",))))
    got = constraints.unique_violations(changes, table, ["k"], ["u"])
    assert {(r.u, r.n) for r in got.collect()} == {(r.u, r.n) for r in full_check(rows, "u").collect()} == {("u11", 2), ("u50", 2), ("new", 2), ("u5", 2)}
    parents = spark.range(20).selectExpr("id as p", "'x' as t")
    bad = constraints.parent_violations(changes, parents, [("f", "p")])
    assert {r.k for r in bad.collect()} == {201, 205}
    fewer = once(diff.diff(parents.where("p <> 4").unionByName(spark.createDataFrame([(77, "y")], parents.schema)), parents, TableSpec("p", ("p",))))
    assert {r.k for r in constraints.parent_violations(changes, parents, [("f", "p")], fewer, ["p"]).collect()} == {203, 205}
    lost = constraints.child_violations(fewer, parents, ["p"], table, [("f", "p")])
    assert [(r.p, r.n) for r in lost.collect()] == [(4, table.where("f = 4").count())]
    moved = once(diff.diff(table.withColumn("f", F.when(F.col("f") == 4, 3).otherwise(F.col("f"))), table, TableSpec("t", ("k",))))
    assert constraints.child_violations(fewer, parents, ["p"], table, [("f", "p")], moved, ["k"]).isEmpty()
    full = checks.orphans(table, parents.where("p <> 4"), [("f", "p")]).count()
    assert lost.first()["n"] == full


def test_the_large_side_is_only_looked_into(spark, tmp_path):
    spark.range(5000).selectExpr("id as k", "concat('u', id) as u").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    changes = once(diff.diff(table.where("k <> 7"), table, TableSpec("t", ("k",))))
    text = constraints.unique_violations(changes, table, ["k"], ["u"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "BroadcastHashJoin" in text and "SortMergeJoin" not in text
