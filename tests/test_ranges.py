"""Key ranges, pages, checksum trees, resumed comparisons, and the duplicate check in the join."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowmend.operators import diff, ranges, tree
from rowmend.operators.columns import align
from rowmend.operators.stats import statistics
from rowmend.plans import resume
from rowmend.spec import TableSpec


def jobs(spark, build):
    """Jobs that run while `build` is called, and its result."""
    spark.sparkContext.setJobGroup("counted", "")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    out = build()
    after = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("other", "")
    return len(after - before), out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ranges") / "t")
    rows = spark.range(20_000).selectExpr("cast(id as int) as id", "concat('k', lpad(cast(id % 97 as string), 3, '0')) as name", "id * 1.5 as x", "cast(date'2024-01-01' + cast(id % 50 as int) as date) as day")
    rows.repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(path)
    return spark.read.parquet(path)


MIXED = [(None, None), (None, "b"), (1, None), (1, "a"), (1, "b"), (1, "b"), (2, "a"), (5, "zz"), (5, ""), (7, None), (-3, "q")]


@pytest.mark.parametrize("rows", [1, 2, 3, 100])
def test_ranges_hold_every_row_once(spark, rows):
    df = spark.createDataFrame(MIXED * 3, "a int, b string")
    made = ranges.key_ranges(df, ["a", "b"], rows)
    listed = made.rows()
    assert sum(r["rows"] for r in listed) == len(MIXED) * 3 and [r["range_no"] for r in listed] == list(range(len(listed)))
    columns = [F.col("a"), F.col("b")]
    for i, r in enumerate(listed):
        assert df.where(ranges.between(columns, *ranges.span(listed, i, i))).count() == r["rows"]
    for fan in (2, 3, 32):
        got = {r["range_no"]: r["count"] for r in ranges.with_range(df, made, fan).groupBy("range_no").count().collect()}
        assert got == {r["range_no"]: r["rows"] for r in listed}
    assert ranges.load_ranges(spark, made.table.inputFiles()[0].rsplit("/", 1)[0]).keys == ["a", "b"]


@pytest.mark.parametrize("kind,values", [("decimal(10,2)", [Decimal("1.50"), None, Decimal("-2.25"), Decimal("9.00")]), ("date", [datetime.date(2024, 1, d) for d in (3, 1, 9)] + [None]), ("timestamp_ntz", [datetime.datetime(2024, 1, d, 5) for d in (3, 1, 9)]), ("binary", [b"\x00\xff", b"", None, b"a"]), ("double", [1.5, float("nan"), None, -0.5]), ("boolean", [True, None, False])])
def test_key_types(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"k {kind}")
    listed = ranges.key_ranges(df, ["k"], 1).rows()
    for i, r in enumerate(listed):
        assert df.where(ranges.between([F.col("k")], *ranges.span(listed, i, i))).count() == r["rows"]


def test_pages_read_their_ranges(spark, table):
    made = ranges.key_ranges(table, ["id"], 1000)
    got = ranges.page(table, made, 3, 700)
    assert [(r.id, r.rn) for r in got.orderBy("rn").collect()] == [(i, i + 1) for i in range(2100, 2800)]
    text = plan(got)
    assert "PushedFilters: [" in text and "GreaterThanOrEqual(id," in text and "InMemoryTableScan" not in text and text.count("FileScan") == 1
    assert ranges.page(table, made, 28, 700).count() == 400 and ranges.page(table, made, 29, 700).isEmpty()
    by_name = ranges.key_ranges(table, ["name", "id"], 1500)
    pages = [r for n in range(3) for r in ranges.page(table, by_name, n, 7000).orderBy("rn").select("name", "id", "rn").collect()]
    assert [r.rn for r in pages] == list(range(1, 20_001)) and [r[:2] for r in pages] == sorted(r[:2] for r in pages)


def test_the_duplicate_check_runs_in_the_join(spark, table):
    spec = TableSpec("t", ("id",))
    count, found = jobs(spark, lambda: diff.diff(table, table.where("id <> 5"), spec))
    assert count == 0 and plan(found).count("Exchange hashpartitioning") == 2 and plan(found).count("FileScan") == 2
    assert found.count() == 1
    count, _ = jobs(spark, lambda: statistics(diff.classify(align(table, table, TableSpec("t", ("name", "id"))))))
    assert count == 0
    with pytest.raises(Exception, match="is not unique"):
        diff.diff(table, table.unionByName(table.where("id = 7")), spec).collect()
    grouped = diff.diff(table, table.unionByName(table.where("id = 7")), TableSpec("t", ("id",), duplicates="first"))
    assert plan(grouped).count("Exchange hashpartitioning") == 2 and grouped.isEmpty()


def drift(df):
    kept = df.where("id <> 4321 and id not between 15000 and 15003").withColumn("x", F.when(F.col("id") == 77, F.lit(None)).otherwise(F.col("x")))
    return kept.unionByName(df.where("id in (3, 19999)").withColumn("id", (F.col("id") + 50_000).cast("int")))


@pytest.mark.parametrize("keys", [("id",), ("name", "id")])
def test_tree_diff_is_diff(spark, table, keys):
    spec, target = TableSpec("t", keys), drift(table)
    want = diff.diff(table, target, spec)
    got = tree.tree_diff(table, target, spec, rows=200)
    assert got.count() == want.count() == 8 and got.exceptAll(want).isEmpty()
    assert tree.tree_diff(table, table, spec, rows=200).isEmpty()
    assert tree.tree_diff(table.limit(0), target, spec, rows=200).count() == target.count()
    assert tree.tree_diff(target, table.limit(0), spec, rows=200).count() == target.count()


def test_tree_reads_and_shuffles_what_differs(spark, table):
    spec, target = TableSpec("t", ("id",)), drift(table)
    m = align(table, target, TableSpec("t", ("id",), duplicates="unique"))
    made = ranges.key_ranges(m.source, m.keys, 200)
    trees = [tree.checksum_tree(side, made, fan=4) for side in (m.source, m.target)]
    assert {r["level"]: r["count"] for r in trees[0].groupBy("level").count().collect()} == {0: 100, 1: 25, 2: 7, 3: 2, 4: 1}
    numbers = tree.differing(*trees, fan=4)
    listed = made.rows()
    assert 4 <= len(numbers) <= 6 and tree.differing(trees[0], trees[0], fan=4) == []
    inside = tree.limited(table, m.keys, m.types, made, numbers)
    assert inside.count() <= sum(listed[n]["rows"] for n in numbers) < 1300
    found = tree.tree_diff(table, target, spec, rows=200)
    text = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert sum("GreaterThanOrEqual(id," in line for line in text.splitlines() if line.startswith("PushedFilters")) >= 2  # on both sides


def test_other_types_and_many_runs(spark, table, monkeypatch):
    monkeypatch.setattr(tree, "RUNS", 1)
    target = drift(table).select(F.col("id").cast("decimal(12,0)").alias("ID"), "name", "x", "day")
    assert tree.tree_diff(table, target, TableSpec("t", ("id",)), rows=300).count() == 8


def test_a_stopped_comparison_goes_on(spark, table, tmp_path, monkeypatch):
    spec, target, path = TableSpec("t", ("id",)), drift(table), str(tmp_path / "run")
    want = diff.diff(table, target, spec)
    calls, real = [], resume.diff

    def fails(source, target, spec):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return real(source, target, spec)

    monkeypatch.setattr(resume, "diff", fails)
    with pytest.raises(RuntimeError, match="lost"):
        resume.resumable_diff(table, target, spec, path, rows=1000, size=3)
    left = resume.unfinished_waves(ranges.load_ranges(spark, f"{path}/ranges"), path, 3)
    assert sorted(left) == [3, 4, 5, 6] and resume.ledger(spark, path).count() == 3
    read = []

    def counted(source, target, spec):
        read.append(source.count())
        return real(source, target, spec)

    monkeypatch.setattr(resume, "diff", counted)
    got = resume.resumable_diff(table, target, spec, path, rows=1000, size=3)
    assert got.exceptAll(want).isEmpty() and got.count() == 8
    assert 10_000 < sum(read[:-1]) < 12_000  # the last call only asks for the columns
    assert resume.resumable_diff(table, target, spec, path, rows=1000, size=3).count() == 8 and len(read) == 6
    assert resume.ledger(spark, path).agg(F.sum("inserts"), F.sum("updates"), F.sum("deletes")).first()[:] == (5, 1, 2)
    with pytest.raises(resume.OtherRunError):
        resume.resumable_diff(table, target, TableSpec("t", ("id",), exclude=("x",)), path, rows=1000, size=3)


def test_some_waves_at_a_time(spark, table, tmp_path):
    spec, target, path = TableSpec("t", ("name", "id")), drift(table), str(tmp_path / "run")
    sizes = [resume.resumable_diff(table, target, spec, path, rows=3000, size=1, most=2).count() for _ in range(4)]
    assert sizes == sorted(sizes) and sizes[-1] == 8
    assert resume.resumable_diff(table.limit(0), target.limit(0), spec, str(tmp_path / "none")).isEmpty()
