"""What larger tables brought up: signed zeros, ranges and resumed comparisons with many ranges, settled duplicates."""

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from rowmend.functions.normalize import normalize
from rowmend.operators import diff, ranges, report, verify
from rowmend.operators.columns import align
from rowmend.operators.stats import statistics
from rowmend.plans import resume
from rowmend.spec import TableSpec


@pytest.mark.parametrize("algorithm", ["md5", "sha1", "sha256"])
def test_a_negative_zero_has_its_sign_in_the_digest(spark, tmp_path, algorithm):
    rows = [(1, "a", 3, -0.0, "M"), (2, "b", 4, 0.0, "M"), (3, "c", 5, -0.25, None)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.c_custkey: r.row_hash for r in entry.queries()[f"row_digest_{algorithm}_customer"](spark, str(tmp_path)).collect()}
    for k, name, nation, balance, segment in rows:
        text = f"c_acctbal:{balance:.15g}|c_mktsegment:{segment or 'NULL'}|c_name:{name}|c_nationkey:{nation}"
        assert got[k] == getattr(hashlib, algorithm)(text.encode()).hexdigest()


def test_changed_columns_tell_zeros_apart_where_the_digest_does(spark):
    source, target = (spark.createDataFrame([(1, x), (2, 1.5)], "k long, x double") for x in (-0.0, 0.0))
    found = diff.diff(source, target, TableSpec("t", ("k",), encoding="compat"))
    assert [r[:] for r in report.changed_columns(found, ["k"], signed_zero=True).collect()] == [(1, "x", "0", "-0")]
    assert verify.verify(found, source, ["k"], signed_zero=True).first().verification_reason == verify.CHANGED
    assert diff.diff(source, target, TableSpec("t", ("k",))).isEmpty()


def tasks(spark, build):
    """Tasks of the jobs that run while `build` is called, and its result."""
    spark.sparkContext.setJobGroup("tasks", "")
    status = spark.sparkContext.statusTracker()
    before = set(status.getJobIdsForGroup("tasks"))
    out = build()
    stages = {i for j in set(status.getJobIdsForGroup("tasks")) - before for i in status.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("other", "")
    return sum(s.numTasks for i in stages if (s := status.getStageInfo(i))), out


def test_tasks_do_not_grow_with_the_number_of_ranges(spark, monkeypatch):
    df = spark.range(6000).selectExpr("id % 2500 as k", "cast(id % 3 as string) as s")
    ran, made = tasks(spark, lambda: ranges.key_ranges(df, ["k", "s"], 10))
    assert ran < 100 and 500 <= made.table.count() <= 600
    monkeypatch.setattr(ranges, "TASK_ROWS", 1000)
    many = ranges.key_ranges(df, ["k", "s"], 10)
    for listed in (made.rows(), many.rows()):
        assert [r["before"] for r in listed] == [sum(x["rows"] for x in listed[:i]) for i in range(len(listed))]
    assert {r["range_no"]: r["count"] for r in ranges.with_range(df, many).groupBy("range_no").count().collect()} == {r["range_no"]: r["rows"] for r in many.rows()}
    monkeypatch.setattr(ranges, "MOST", 40)
    assert ranges.key_ranges(df, ["k"], 10).table.count() <= 40


def test_one_frequent_key_is_one_range(spark, monkeypatch):
    monkeypatch.setattr(ranges, "TASK_ROWS", 500)
    df = spark.range(3000).selectExpr("case when id % 2 = 0 then 700 else id end as k")
    listed = ranges.key_ranges(df, ["k"], 100).rows()
    assert sum(r["rows"] for r in listed) == 3000 and len({r["lo"] for r in listed}) == len(listed)
    for i, r in enumerate(listed):
        assert df.where(ranges.between([F.col("k")], *ranges.span(listed, i, i))).count() == r["rows"]


def test_many_waves_share_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resume, "ROUNDS", 3)
    source = spark.range(2000).selectExpr("id as k", "id * 0.5 as x")
    target = source.where("k % 40 <> 3").withColumn("x", F.when(F.col("k") == 1999, -1.0).otherwise(F.col("x")))
    spec, path, calls, real = TableSpec("t", ("k",)), str(tmp_path / "run"), [], resume.diff

    def stops(a, b, spec):
        calls.append(a.count())
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(a, b, spec)

    monkeypatch.setattr(resume, "diff", stops)
    assert resume.resumable_diff(source, target, spec, path, rows=50, size=1, most=1).count() == 2  # wave 0 and the columns
    with pytest.raises(RuntimeError, match="lost"):
        resume.resumable_diff(source, target, spec, path, rows=50, size=1)
    made = ranges.load_ranges(spark, f"{path}/ranges")
    assert calls[0] == 50 and sorted(resume.unfinished_waves(made, path, 1)) == list(range(1, 40))
    got = resume.resumable_diff(source, target, spec, path, rows=50, size=1)
    assert got.exceptAll(real(source, target, spec)).isEmpty() and got.count() == 51 and len(calls) == 7  # three rounds, the columns
    rows = {r.wave: (r.inserts, r.updates, r.deletes) for r in resume.ledger(spark, path).collect()}
    assert sorted(rows) == list(range(40)) and rows[39][1] == 1 and sum(r[0] for r in rows.values()) == 50
    assert rows[0] == (2, 0, 0) and resume.unfinished_waves(made, path, 1) == {}


def test_short_floats_have_the_text_of_the_long_way(spark):
    values = [x * s for x in (0.0, 0.05, 0.001, 0.002, 0.00099, 1.0, 10.0, 100.5, 33.33, 1 / 3, 0.1 + 0.2, 9_999_999.0, 9_999_999.5, 1e7, 1e-9, 123456.789012345678, 1e22) for s in (1, -1)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select(normalize(F.col("x"), T.DoubleType(), None, True).alias("y"))
    assert [r.y for r in got.collect()] == [f"{x:.15g}" for x in values]


@pytest.mark.parametrize("policy", ["first", "exclude"])
def test_counts_over_settled_duplicates_leave_the_rows_behind(spark, policy):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "c", 3.0), (None, "d", 4.0)], "k long, wide string, x double")
    spec = TableSpec("t", ("k",), duplicates=policy)
    counted = statistics(diff.classify(align(df, df, spec)))
    assert counted.first().source_row_count == (3 if policy == "first" else 2) and counted.first().total_differences == 0
    assert "min(struct(" not in counted._jdf.queryExecution().optimizedPlan().toString()
    whole = {r.k: (r.wide, r.x) for r in align(df, df, spec).source.collect()}
    assert (whole.pop(1, None) in ((("a", 1.0), ("b", 2.0)) if policy == "first" else (None,))) and whole == {2: ("c", 3.0), None: ("d", 4.0)}
