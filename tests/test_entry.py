import importlib

import pytest

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_sql_unless_it_cannot():
    entry = importlib.import_module("__spark_entry__")
    missing = [n for n in entry.queries() if n not in entry.oracle_sql()]
    assert all(n.startswith("op") or n == "pipeline" for n in missing)


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", ["diff_changes_nation", "sync_sql_target_nation", "duplicate_keys", "audit_last_metric", "schema_compatibility"])
def test_some_queries_run(spark, name):
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries()[name](spark, SMALL).count() > 0
