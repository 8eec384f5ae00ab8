"""The registered queries: each table against a drifted copy of itself, with the same drift and result in SQL.

The drifted copy (`target`) is the table with rows dropped (inserts), a number and two texts changed (updates) and rows
added under new keys (deletes); `current` is what becomes of it before verification.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.functions.literals import literal
from rowmend.functions.normalize import base64_text, clob_text, date_string_text, decimal_text, flag_text, json_text, normalize
from rowmend.operators import audit, checks, constraints, diff, paging, profile, report, sqlgen, stats, tree, verify
from rowmend.operators.columns import align
from rowmend.operators.merge import merge_changes
from rowmend.operators.store import folder, once
from rowmend.plans import run
from rowmend.plans.resume import resumable_diff
from rowmend.sources import events, io
from rowmend.sources.io import read_query
from rowmend.spec import TableSpec

#: table: key, other columns with kinds (i integer, f float, s text, t timestamp), number changed, text set null, text extended.
TABLES = {
    "nation": ("n_nationkey", {"n_name": "s", "n_regionkey": "i"}, "n_regionkey", "n_name", "n_name"),
    "supplier": ("s_suppkey", {"s_name": "s", "s_nationkey": "i", "s_acctbal": "f"}, "s_acctbal", "s_name", "s_name"),
    "customer": ("c_custkey", {"c_name": "s", "c_nationkey": "i", "c_acctbal": "f", "c_mktsegment": "s"}, "c_acctbal", "c_mktsegment", "c_name"),
    "part": ("p_partkey", {"p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "i", "p_retailprice": "f"}, "p_retailprice", "p_brand", "p_name"),
    "orders": ("o_orderkey", {"o_custkey": "i", "o_orderstatus": "s", "o_totalprice": "f", "o_orderdate": "t", "o_orderpriority": "s"}, "o_totalprice", "o_orderstatus", "o_orderpriority"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spec(name: str, **more) -> TableSpec:
    return TableSpec(name, (TABLES[name][0],), encoding=more.pop("encoding", "compat"), **more)


def drifted(df: DataFrame, name: str, later: bool = False) -> DataFrame:
    """The target; with `later`, what it has become when changes are verified."""
    key, _, number, nulled, quoted = TABLES[name]
    k = F.col(key)
    kept = df.where((k % 17 != 3) | (F.lit(later) & (k % 2 == 1)))
    untouched = k % 17 == 3
    if later:
        kept = kept.where(untouched | (k % 23 != 7) | (k % 2 != 0))
    again = F.when(F.lit(later) & (k % 3 == 0), 1).otherwise(0)
    new = {number: F.when(~untouched & (k % 13 == 5), F.col(number) + 1 + again).otherwise(F.col(number)).cast(df.schema[number].dataType)}
    new[quoted] = F.when(~untouched & (k % 29 == 11), F.concat(F.col(quoted), F.lit("'x"))).otherwise(F.col(quoted))
    new[nulled] = F.when(~untouched & (k % 23 == 7), F.lit(None)).otherwise(new.get(nulled, F.col(nulled)))
    added = df.where((k % 19 == 7) & (F.lit(not later) | (k % 2 == 1))).withColumn(key, (k + 10000000).cast(df.schema[key].dataType))
    return kept.withColumns(new).unionByName(added)


def sides(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    df = load(spark, sf_dir, name)
    return df, drifted(df, name)


def changes(spark: SparkSession, sf_dir: str, name: str, **more) -> DataFrame:
    return diff.diff(*sides(spark, sf_dir, name), spec(name, **more))


# ---------------------------------------------------------------- the same in SQL


def _drift_sql(name: str, later: bool = False) -> str:
    key, columns, number, nulled, quoted = TABLES[name]
    off = f"{key} % 17 = 3"
    out = {c: c for c in [key, *columns]}
    step = f"CASE WHEN {key} % 3 = 0 THEN 2 ELSE 1 END" if later else "1"
    out[number] = f"CASE WHEN NOT {off} AND {key} % 13 = 5 THEN {number} + {step} ELSE {number} END"
    out[quoted] = f"CASE WHEN NOT {off} AND {key} % 29 = 11 THEN {quoted} || '''x' ELSE {quoted} END"
    out[nulled] = f"CASE WHEN NOT {off} AND {key} % 23 = 7 THEN NULL ELSE {out[nulled]} END"
    keep = f"({key} % 17 <> 3 OR {key} % 2 = 1) AND ({off} OR {key} % 23 <> 7 OR {key} % 2 <> 0)" if later else f"{key} % 17 <> 3"
    extra = f" AND {key} % 2 = 1" if later else ""
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in out.items())} FROM {name} WHERE {keep} UNION ALL SELECT {', '.join(f'{c} + 10000000 AS {c}' if c == key else c for c in out)} FROM {name} WHERE {key} % 19 = 7{extra}"


def _form_sql(c: str, kind: str) -> str:
    return {"i": f"CAST({c} AS VARCHAR)", "s": c, "f": f"printf('%.15g', {c})", "t": f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"}[kind]


def _text_sql(name: str) -> str:
    return "concat_ws('|', " + ", ".join(f"'{c}:' || coalesce({_form_sql(c, k)}, 'NULL')" for c, k in sorted(TABLES[name][1].items())) + ")"


def _hash_sql(name: str, algorithm: str = "sha256") -> str:
    return f"{algorithm}({_text_sql(name)})"


def _both_sql(name: str) -> str:
    """CTEs s and t (with digests h), and j: every key with its op."""
    key = TABLES[name][0]
    return f"""
WITH s AS (SELECT *, {_hash_sql(name)} AS h FROM {name}), t0 AS ({_drift_sql(name)}), t AS (SELECT *, {_hash_sql(name)} AS h FROM t0),
j AS (SELECT coalesce(s.{key}, t.{key}) AS k, s.h AS sh, t.h AS th,
  CASE WHEN t.{key} IS NULL THEN 'INSERT' WHEN s.{key} IS NULL THEN 'DELETE' WHEN s.h <> t.h THEN 'UPDATE' ELSE 'MATCH' END AS op
  FROM s FULL JOIN t ON s.{key} IS NOT DISTINCT FROM t.{key})"""


def _stats_sql(name: str) -> str:
    return f"""{_both_sql(name)},
c AS (SELECT count(*) FILTER (op <> 'DELETE') AS source_row_count, count(*) FILTER (op <> 'INSERT') AS target_row_count,
  count(*) FILTER (op = 'INSERT') AS insert_count, count(*) FILTER (op = 'UPDATE') AS update_count, count(*) FILTER (op = 'DELETE') AS delete_count FROM j),
d AS (SELECT *, insert_count + update_count + delete_count AS total_differences, greatest(source_row_count, target_row_count) AS most FROM c)
SELECT source_row_count, target_row_count, insert_count, update_count, delete_count, total_differences,
  round(CASE WHEN most = 0 THEN 0.0 ELSE 100.0 * CAST(most - total_differences AS DOUBLE) / greatest(most, 1) END, 2) AS match_percentage FROM d"""


def _literal_sql(c: str, kind: str) -> str:
    if kind == "t":
        return f"coalesce('TIMESTAMP ' || chr(39) || strftime({c}, '%Y-%m-%d %H:%M:%S.%f') || chr(39), 'NULL')"
    return f"coalesce({c if kind != 's' else f'chr(39) || replace({c}, chr(39), chr(39) || chr(39)) || chr(39)'}, 'NULL')" if kind == "s" else f"coalesce(CAST({c} AS VARCHAR), 'NULL')"


def _sync_sql(name: str, side: str) -> str:
    key, columns = TABLES[name][0], TABLES[name][1]
    new, old = ("s", "t") if side == "target" else ("t", "s")
    kinds = {key: "i", **dict(sorted(columns.items()))}
    table = f"MAIN.{name.upper()}"
    values = " || ', ' || ".join(_literal_sql(f"{new}.{c}", k) for c, k in kinds.items())
    sets = " || ', ' || ".join(f"'{c.upper()} = ' || {_literal_sql(f'{new}.{c}', k)}" for c, k in kinds.items() if c != key)
    return f"""{_both_sql(name)}
SELECT '{name}' AS table_name, '{side}' AS side, CASE x.op WHEN 'DELETE' THEN 0 WHEN 'INSERT' THEN 1 ELSE 2 END AS op_rank, x.op AS op, k AS {key},
  CASE x.op WHEN 'INSERT' THEN 'INSERT INTO {table} ({', '.join(c.upper() for c in kinds)}) VALUES (' || {values} || ');'
    WHEN 'DELETE' THEN 'DELETE FROM {table} WHERE {key.upper()} = ' || {old}.{key} || ';'
    ELSE 'UPDATE {table} SET ' || {sets} || ' WHERE {key.upper()} = ' || {new}.{key} || ';' END AS statement
FROM (SELECT k, {"op" if side == "target" else "CASE op WHEN 'INSERT' THEN 'DELETE' WHEN 'DELETE' THEN 'INSERT' ELSE op END AS op"} FROM j WHERE op <> 'MATCH') x
LEFT JOIN s ON s.{key} = k LEFT JOIN t ON t.{key} = k"""


def _changed_sql(name: str) -> str:
    key, columns = TABLES[name][0], TABLES[name][1]
    parts = [f"SELECT s.{key} AS {key}, '{c}' AS column_name, {_form_sql(f't.{c}', k)} AS old_value, {_form_sql(f's.{c}', k)} AS new_value FROM s JOIN t USING ({key}) WHERE {_form_sql(f's.{c}', k)} IS DISTINCT FROM {_form_sql(f't.{c}', k)}" for c, k in columns.items()]
    return f"{_both_sql(name)} {' UNION ALL '.join(parts)}"


def _verified_sql(name: str) -> str:
    key, columns = TABLES[name][0], TABLES[name][1]
    same = " AND ".join(f"{_form_sql(f't.{c}', k)} IS NOT DISTINCT FROM {_form_sql(f'u.{c}', k)}" for c, k in columns.items())
    return f"""{_both_sql(name)}, u AS ({_drift_sql(name, later=True)}),
v AS (SELECT j.op, k AS {key}, CASE
  WHEN op = 'INSERT' AND u.{key} IS NULL THEN 'Primary key does not exist in target' WHEN op = 'INSERT' THEN 'Primary key already exists in target'
  WHEN op = 'UPDATE' AND u.{key} IS NULL THEN 'Row not found in target' WHEN op = 'UPDATE' AND ({same}) THEN 'Row exists and matches expected data'
  WHEN op = 'UPDATE' THEN 'Row data changed since comparison' WHEN u.{key} IS NULL THEN 'Row not found in target' ELSE 'Row exists in target' END AS verification_reason
  FROM j LEFT JOIN t ON t.{key} = k LEFT JOIN u ON u.{key} = k WHERE op <> 'MATCH'),
w AS (SELECT *, CASE WHEN verification_reason IN ('Primary key does not exist in target', 'Row exists and matches expected data', 'Row exists in target') THEN 'VALID' ELSE 'INVALID' END AS verification_status FROM v)"""


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None):
    def put(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def _digests(name: str, algorithm: str):
    key = TABLES[name][0]

    def query(spark, d):
        df = load(spark, d, name)
        return align(df, df, spec(name, algorithm=algorithm)).source.select(key, "row_hash")

    add(f"row_digest_{algorithm}_{name}", f"SELECT {key}, {_hash_sql(name, algorithm)} AS row_hash FROM {name}")(query)


for _a in ("md5", "sha1", "sha256"):
    for _n in ("orders", "customer"):
        _digests(_n, _a)


def _of_table(kind: str, names: tuple[str, ...], query, sql):
    for n in names:
        add(f"{kind}_{n}", sql(n) if sql else None)(lambda s, d, n=n: query(s, d, n))


ALL = tuple(TABLES)
_of_table("diff_changes", ALL, lambda s, d, n: changes(s, d, n).select("op", TABLES[n][0], "source_hash", "target_hash"), lambda n: f"{_both_sql(n)} SELECT op, k AS {TABLES[n][0]}, sh AS source_hash, th AS target_hash FROM j WHERE op <> 'MATCH'")
_of_table("diff_thin", ("orders",), lambda s, d, n: diff.thin_diff(*sides(s, d, n), spec(n)).select("op", TABLES[n][0], "source_hash", "target_hash", F.col(f"source_data.{TABLES[n][2]}").alias("source_value")), lambda n: f"{_both_sql(n)} SELECT op, k AS {TABLES[n][0]}, sh AS source_hash, th AS target_hash, s.{TABLES[n][2]} AS source_value FROM j LEFT JOIN s ON s.{TABLES[n][0]} = k WHERE op <> 'MATCH'")
_of_table("diff_inserts", ("customer", "part"), lambda s, d, n: diff.inserts(*sides(s, d, n), spec(n)), lambda n: f"{_both_sql(n)} SELECT {', '.join([TABLES[n][0], *sorted(TABLES[n][1])])}, h AS row_hash FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.{TABLES[n][0]} = s.{TABLES[n][0]})")
_of_table("diff_deletes", ("customer", "part"), lambda s, d, n: diff.deletes(*sides(s, d, n), spec(n)), lambda n: f"{_both_sql(n)} SELECT {', '.join([TABLES[n][0], *sorted(TABLES[n][1])])}, h AS row_hash FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE t.{TABLES[n][0]} = s.{TABLES[n][0]})")
_of_table("diff_updates", ("customer", "part"), lambda s, d, n: diff.updates(*sides(s, d, n), spec(n)).select(TABLES[n][0], "source_hash", "target_hash"), lambda n: f"{_both_sql(n)} SELECT k AS {TABLES[n][0]}, sh AS source_hash, th AS target_hash FROM j WHERE op = 'UPDATE'")
_of_table("key_except", ("supplier", "orders"), lambda s, d, n: diff.key_except(*sides(s, d, n), [TABLES[n][0]]), lambda n: f"WITH t AS ({_drift_sql(n)}) SELECT {TABLES[n][0]} FROM {n} EXCEPT SELECT {TABLES[n][0]} FROM t")
_of_table("key_intersect", ("supplier", "orders"), lambda s, d, n: diff.key_intersect(*sides(s, d, n), [TABLES[n][0]]), lambda n: f"WITH t AS ({_drift_sql(n)}) SELECT {TABLES[n][0]} FROM {n} INTERSECT SELECT {TABLES[n][0]} FROM t")
_of_table("comparison_stats", ALL, lambda s, d, n: stats.statistics(diff.classify(align(*sides(s, d, n), spec(n)))).drop("match_percentage_clamped"), _stats_sql)
_of_table("changed_columns", ("customer", "orders"), lambda s, d, n: report.changed_columns(changes(s, d, n), [TABLES[n][0]], signed_zero=True), _changed_sql)
_of_table("changed_column_counts", ("customer",), lambda s, d, n: report.changed_column_counts(report.changed_columns(changes(s, d, n), [TABLES[n][0]], signed_zero=True)), lambda n: f"SELECT column_name, count(*) AS updates FROM ({_changed_sql(n)}) GROUP BY column_name")
_of_table("apply_changes", ("customer", "orders"), lambda s, d, n: diff.apply_changes(drifted(load(s, d, n), n), changes(s, d, n), [TABLES[n][0]]), lambda n: f"SELECT * FROM {n}")
_of_table("reverse_changes", ("customer",), lambda s, d, n: diff.apply_changes(load(s, d, n), diff.reverse(changes(s, d, n)), [TABLES[n][0]]), _drift_sql)
_of_table("verify_operations", ("orders", "customer"), lambda s, d, n: verify.verify(changes(s, d, n), drifted(load(s, d, n), n, later=True), [TABLES[n][0]], signed_zero=True).select("op", TABLES[n][0], "verification_status", "verification_reason"), lambda n: f"{_verified_sql(n)} SELECT op, {TABLES[n][0]}, verification_status, verification_reason FROM w")
_of_table("verification_stats", ("orders",), lambda s, d, n: verify.verification_statistics(verify.verify(changes(s, d, n), drifted(load(s, d, n), n, later=True), [TABLES[n][0]], signed_zero=True)), lambda n: f"{_verified_sql(n)} SELECT coalesce(op, 'TOTAL') AS op, count(*) AS original, count(*) FILTER (verification_status = 'VALID') AS valid, count(*) FILTER (verification_status <> 'VALID') AS invalid, round(100.0 * CAST(count(*) FILTER (verification_status = 'VALID') AS DOUBLE) / count(*), 2) AS valid_percentage FROM w GROUP BY ROLLUP (op)")
_of_table("verified_sync_sql", ("supplier",), lambda s, d, n: run.verified_statements(changes(s, d, n), drifted(load(s, d, n), n, later=True), spec(n)).select("op", TABLES[n][0]), lambda n: f"{_verified_sql(n)} SELECT op, {TABLES[n][0]} FROM w WHERE verification_status = 'VALID'")
_of_table("sync_sql_target", ("nation", "supplier", "orders"), lambda s, d, n: sqlgen.statements(changes(s, d, n), spec(n), "target"), lambda n: _sync_sql(n, "target"))
_of_table("sync_sql_source", ("nation", "supplier"), lambda s, d, n: sqlgen.statements(changes(s, d, n), spec(n), "source"), lambda n: _sync_sql(n, "source"))
_of_table("statement_counts", ("customer",), lambda s, d, n: stats.statement_counts(sqlgen.statements(changes(s, d, n), spec(n))), lambda n: f"{_both_sql(n)} SELECT '{n}' AS table_name, 'target' AS side, op, count(*) AS statements FROM j WHERE op <> 'MATCH' GROUP BY op")
_of_table("sample_differences", ("orders",), lambda s, d, n: report.samples(changes(s, d, n), [TABLES[n][0]]), lambda n: f"{_both_sql(n)} SELECT op, CAST(r AS INTEGER) AS sample, k AS {TABLES[n][0]}, substr(sh, 1, 16) AS source_hash, substr(th, 1, 16) AS target_hash FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY k) AS r FROM j WHERE op <> 'MATCH') WHERE r <= 5")
_of_table("sample_more", ("orders",), lambda s, d, n: report.more_counts(changes(s, d, n)), lambda n: f"{_both_sql(n)} SELECT op, count(*) AS total, greatest(0, count(*) - 5) AS more FROM j WHERE op <> 'MATCH' GROUP BY op")
_of_table("filtered_diff", ("orders",), lambda s, d, n: changes(s, d, n, where="o_totalprice > 100000", exclude=("O_ORDERSTATUS",)).groupBy("op").agg(F.count("*").alias("n")), lambda n: f"WITH s AS (SELECT * FROM orders WHERE o_totalprice > 100000), t AS (SELECT * FROM ({_drift_sql(n)}) WHERE o_totalprice > 100000) SELECT CASE WHEN t.o_orderkey IS NULL THEN 'INSERT' WHEN s.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op, count(*) AS n FROM s FULL JOIN t ON s.o_orderkey = t.o_orderkey WHERE s.o_orderkey IS NULL OR t.o_orderkey IS NULL OR s.o_custkey <> t.o_custkey OR s.o_totalprice <> t.o_totalprice OR s.o_orderdate <> t.o_orderdate OR s.o_orderpriority <> t.o_orderpriority GROUP BY 1")
_of_table("page", ("orders",), lambda s, d, n: paging.page(load(s, d, n), [TABLES[n][0]], 1, 1000), lambda n: f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {TABLES[n][0]}) AS rn FROM {n}) WHERE rn > 1000 AND rn <= 2000")
_of_table("row_numbers", ("customer",), lambda s, d, n: paging.with_row_number(load(s, d, n), [TABLES[n][0]]).select(TABLES[n][0], "rn"), lambda n: f"SELECT {TABLES[n][0]}, row_number() OVER (ORDER BY {TABLES[n][0]}) AS rn FROM {n}")
_of_table("page_counts", ("orders",), lambda s, d, n: stats.page_counts(stats.statistics(diff.classify(align(*sides(s, d, n), spec(n)))), 1000).select("pages"), lambda n: f"SELECT CAST(ceil(greatest((SELECT count(*) FROM {n}), (SELECT count(*) FROM ({_drift_sql(n)}))) / 1000.0) AS BIGINT) AS pages")
_of_table("changed_buckets", ("orders",), lambda s, d, n: diff.changed_buckets(*sides(s, d, n), spec(n)).join(changes(s, d, n).select(F.pmod(F.xxhash64(TABLES[n][0]), F.lit(1024)).alias("bucket")).distinct(), "bucket", "full_outer").agg(F.count_if(F.col("source_sum").isNull() & F.col("target_sum").isNull()).alias("missed")), lambda n: "SELECT CAST(0 AS BIGINT) AS missed")

RUN = ("customer", "part", "orders", "supplier")


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    return run.union_summaries([run.compare_table(*sides(spark, d, n), spec(n)) for n in RUN])


_SUMMARY_SQL = " UNION ALL ".join(f"SELECT '{n}' AS table_name, * FROM ({_stats_sql(n)})" for n in RUN)
add("table_summaries", _SUMMARY_SQL)(lambda s, d: _summaries(s, d).select("table_name", "source_row_count", "target_row_count", "insert_count", "update_count", "delete_count", "total_differences", "match_percentage"))
add("run_summary", f"SELECT count(*) AS tables, count(*) AS succeeded, CAST(0 AS BIGINT) AS failed, CAST(sum(total_differences) AS BIGINT) AS total_differences, count(*) FILTER (total_differences > 0) AS tables_needing_sync FROM ({_SUMMARY_SQL})")(lambda s, d: stats.run_summary(_summaries(s, d)))
add("run_totals", f"SELECT *, round(100.0 * CAST(greatest(source_row_count, target_row_count) - total_differences AS DOUBLE) / greatest(source_row_count, target_row_count), 2) AS match_percentage FROM (SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('source_row_count', 'target_row_count', 'insert_count', 'update_count', 'delete_count', 'total_differences'))} FROM ({_SUMMARY_SQL}))")(lambda s, d: stats.run_totals(_summaries(s, d)))
add("compare_many", f"SELECT table_name, 'SUCCESS' AS status, total_differences FROM ({_SUMMARY_SQL}) UNION ALL SELECT 'broken', 'ERROR', -1")(lambda s, d: run.compare_tables(s, [(spec(n), lambda n=n: load(s, d, n), lambda n=n: drifted(load(s, d, n), n)) for n in RUN] + [(TableSpec("broken", ("no_such_key",)), lambda: load(s, d, "nation"), lambda: load(s, d, "nation"))]).select("table_name", "status", F.coalesce("total_differences", F.lit(-1)).alias("total_differences")))
add("union_changes", " UNION ALL ".join(f"SELECT '{n}' AS table_name, op, count(*) AS n FROM ({_both_sql(n)} SELECT op FROM j WHERE op <> 'MATCH') GROUP BY op" for n in ("customer", "part")))(lambda s, d: diff.union_changes({n: changes(s, d, n) for n in ("customer", "part")}, {n: [TABLES[n][0]] for n in ("customer", "part")}).groupBy("table_name", "op").agg(F.count("*").alias("n")))
add("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")(lambda s, d: checks.duplicate_keys(load(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]))
add("duplicates_excluded", "WITH u AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) = 1) SELECT count(*) AS source_row_count FROM u")(lambda s, d: stats.statistics(diff.classify(align(load(s, d, "lineitem"), load(s, d, "lineitem"), TableSpec("lineitem", ("l_orderkey", "l_linenumber"), duplicates="exclude")))).select("source_row_count"))
add("duplicates_first", "SELECT count(*) AS source_row_count, CAST(0 AS BIGINT) AS total_differences FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")(lambda s, d: stats.statistics(diff.classify(align(load(s, d, "lineitem"), load(s, d, "lineitem"), TableSpec("lineitem", ("l_orderkey", "l_linenumber"), duplicates="first")))).select("source_row_count", "total_differences"))
add("composite_key_diff", "WITH t AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 13 = 5 THEN text || '!' ELSE text END AS text FROM conversations WHERE (conv_id + turn) % 17 <> 3) SELECT CASE WHEN t.conv_id IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS op, conv_id, turn FROM conversations s LEFT JOIN t USING (conv_id, turn) WHERE t.role IS NULL OR s.text <> t.text")(lambda s, d: diff.diff(c := load(s, d, "conversations"), c.where((F.col("conv_id") + F.col("turn")) % 17 != 3).withColumn("text", F.when(F.col("conv_id") % 13 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), TableSpec("conversations", ("conv_id", "turn"))).select("op", "conv_id", "turn"))
add("array_diff", "SELECT vec_id FROM embeddings WHERE vec_id % 7 = 3 AND len(embedding) > 1")(lambda s, d: diff.updates(e := load(s, d, "embeddings"), e.withColumn("embedding", F.when(F.col("vec_id") % 7 == 3, F.slice("embedding", 1, 1)).otherwise(F.col("embedding"))), TableSpec("embeddings", ("vec_id",))).select("vec_id"))

_ALTERED = (("c_custkey", "integer", "decimal", "warning", "c_custkey", "c_custkey", "FALSE"), ("c_name", "varchar", "integer", "error", "c_name", "c_custkey", "TRY_CAST(c_name AS INTEGER) IS NULL"), ("c_nationkey", "integer", "varchar", "error", "c_nationkey", "c_nationkey", "FALSE"), ("c_acctbal", "float", "integer", "warning", "c_acctbal", "c_nationkey", "FALSE"), ("c_mktsegment", "varchar", None, "warning", "c_mktsegment", "NULL", "FALSE"), ("c_new", None, "date", "warning", "NULL", "NULL", "FALSE"))
add("schema_compatibility", " UNION ALL ".join(f"SELECT '{n}' AS column_name, {repr(a) if a else 'NULL'} AS source_type, {repr(b) if b else 'NULL'} AS target_type, '{v}' AS verdict, count({x}) AS source_values, count({y}) AS target_values, count(*) FILTER ({x} IS NOT NULL AND {bad}) AS misfits FROM customer" for n, a, b, v, x, y, bad in _ALTERED))(lambda s, d: profile.compatibility(c := load(s, d, "customer"), c.select(F.col("c_custkey").cast("decimal(20,0)").alias("C_CUSTKEY"), F.col("c_custkey").alias("c_name"), F.col("c_nationkey").cast("string").alias("c_nationkey"), F.col("c_nationkey").alias("c_acctbal"), F.lit(None).cast("date").alias("c_new"))))
add("cross_type_diff", "SELECT CAST(0 AS BIGINT) AS total_differences")(lambda s, d: stats.statistics(diff.classify(align(c := load(s, d, "customer"), c.select(F.col("c_custkey").cast("decimal(20,0)").alias("C_CUSTKEY"), F.col("c_mktsegment").alias("C_MKTSEGMENT"), "c_acctbal", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_name"), spec("customer")))).select("total_differences"))
_of_table("table_metadata", ("orders", "customer"), lambda s, d, n: profile.table_profile(load(s, d, n), (TABLES[n][0],)).select("column_name", "position", F.coalesce("key_position", F.lit(-1)).alias("key_position"), "rows", "nulls", "lo", "hi"), lambda n: " UNION ALL ".join(f"SELECT '{c}' AS column_name, {i} AS position, {0 if i == 0 else -1} AS key_position, count(*) AS rows, count(*) - count({c}) AS nulls, {_form_sql(f'min({c})', k)} AS lo, {_form_sql(f'max({c})', k)} AS hi FROM {n}" for i, (c, k) in enumerate({TABLES[n][0]: "i", **TABLES[n][1]}.items())))
Q["table_metadata"], SQL["table_metadata"] = Q.pop("table_metadata_orders"), SQL.pop("table_metadata_orders")
add("row_count_filtered", "SELECT count(*) AS row_count FROM orders WHERE o_totalprice > 100000")(lambda s, d: stats.row_count(load(s, d, "orders"), "o_totalprice > 100000"))
add("json_normal_form", "SELECT event_id, CAST(json(props) AS VARCHAR) AS props FROM events")(lambda s, d: load(s, d, "events").select("event_id", json_text(F.col("props")).alias("props")))
add("json_compare", "SELECT CAST(0 AS BIGINT) AS n")(lambda s, d: diff.updates(e := load(s, d, "events").select("event_id", "props"), e.withColumn("props", F.regexp_replace("props", r"\s+", "  ")), TableSpec("events", ("event_id",), tags={"props": "json"})).agg(F.count("*").alias("n")))
_SHAPES = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "dd-MMM-yyyy", "dd-MMM-yyyy HH:mm:ss", "M/d/yyyy", "MM/dd/yyyy HH:mm:ss")
add("date_string_normal_form", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")(lambda s, d: load(s, d, "orders").select("o_orderkey", date_string_text(F.coalesce(*[F.when(F.col("o_orderkey") % 7 == i, F.date_format("o_orderdate", f)) for i, f in enumerate(_SHAPES)])).alias("d")))
add("clob_eol_compare", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\n', chr(13) || chr(10), 'g'), chr(13) || chr(10) || '|' || chr(13), chr(10), 'g')) AS h FROM documents")(lambda s, d: load(s, d, "documents").select("doc_id", F.md5(clob_text(F.regexp_replace("text", "\n", "\r\n")).cast("binary")).alias("h")))


def audit_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "SESSION_START").when(F.col("event_type") == "purchase", "TABLE_COMPLETE").when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "PERFORMANCE_METRIC").otherwise("WARNING")
    details = F.to_json(F.struct(F.concat(F.lit("T"), F.col("user_id") % 7).alias("table_name"), F.concat(F.lit("m"), F.col("event_id") % 5).alias("metric_name"), "value", F.lit("seconds").alias("unit")))
    return load(spark, d, "events").select(F.col("ts").alias("timestamp"), F.concat(F.lit("s"), F.col("user_id") % 10).alias("session_id"), kind.alias("event_type"), F.concat(F.lit("event "), "event_id").alias("message"), F.lit(0).cast("long").alias("thread_id"), details.alias("details"))


_E = "WITH e AS (SELECT ts AS timestamp, 's' || (user_id % 10) AS session_id, CASE event_type WHEN 'signup' THEN 'SESSION_START' WHEN 'purchase' THEN 'TABLE_COMPLETE' WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'PERFORMANCE_METRIC' ELSE 'WARNING' END AS event_type, 'event ' || event_id AS message, 'T' || (user_id % 7) AS table_name, 'm' || (event_id % 5) AS metric_name, value FROM events)"
add("audit_event_counts", f"{_E} SELECT session_id, event_type, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT session_id, 'ALL', count(*) FROM e GROUP BY session_id")(lambda s, d: audit.event_counts(audit_events(s, d)))
add("audit_tables_seen", f"{_E} SELECT DISTINCT session_id, table_name FROM e")(lambda s, d: audit.tables_seen(audit_events(s, d)))
add("audit_last_metric", f"{_E} SELECT session_id, metric_name, value, 'seconds' AS unit FROM (SELECT *, row_number() OVER (PARTITION BY session_id, metric_name ORDER BY timestamp DESC, message DESC) AS r FROM e WHERE event_type = 'PERFORMANCE_METRIC') WHERE r = 1")(lambda s, d: audit.last_metrics(audit_events(s, d)))
add("audit_errors", f"{_E} SELECT session_id, event_type, timestamp, message FROM e WHERE event_type IN ('ERROR', 'WARNING')")(lambda s, d: audit.problems(audit_events(s, d)).drop("details"))
add("audit_duration", f"{_E} SELECT session_id, CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp) FILTER (event_type = 'SESSION_START'))) / 1000000.0) AS BIGINT) AS seconds FROM e GROUP BY session_id")(lambda s, d: audit.durations(audit_events(s, d)))
add("audit_events_of_type", f"{_E} SELECT session_id, message FROM e WHERE event_type = 'ERROR'")(lambda s, d: audit.of_type(audit_events(s, d), "ERROR").select("session_id", "message"))
add("audit_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")(lambda s, d: audit.unfinished(o := load(s, d, "orders").select("o_orderkey"), o.where("o_orderkey % 3 = 0"), ["o_orderkey"]))
add("foreign_key_orphans", f"WITH c AS ({_drift_sql('customer')}) SELECT o_orderkey, o_custkey FROM orders o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c_custkey = o_custkey)")(lambda s, d: checks.orphans(load(s, d, "orders"), drifted(load(s, d, "customer"), "customer"), [("o_custkey", "c_custkey")]).select("o_orderkey", "o_custkey"))
add("unique_violations", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")(lambda s, d: checks.duplicate_keys(load(s, d, "orders"), ["o_custkey"]))
add("type_fit", "SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS x FROM part) WHERE x IS NOT NULL AND TRY_CAST(x AS INTEGER) IS NULL")(lambda s, d: checks.misfits(load(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string")).alias("x")), "x", "int").select("p_partkey"))
add("masked_columns", "SELECT c_custkey, sha256(c_name) AS c_name FROM customer")(lambda s, d: checks.masked(load(s, d, "customer"), ["c_name"], digest=True).select("c_custkey", "c_name"))

# ---------------------------------------------------------------- reports, run events, literals and forms of single columns


def _verified(spark: SparkSession, d: str, name: str) -> DataFrame:
    return verify.verify(changes(spark, d, name), drifted(load(spark, d, name), name, later=True), [TABLES[name][0]], signed_zero=True).select(F.lit(name).alias("table_name"), "verification_status")


def _sample_values_sql(name: str, columns: int = 10) -> str:
    key, kinds = TABLES[name][0], {TABLES[name][0]: "i", **dict(sorted(TABLES[name][1].items()))}
    parts = [f"SELECT op, r, k, '{c}' AS \"column\", substr(CASE WHEN op = 'DELETE' THEN {_form_sql(f't.{c}', kind)} ELSE {_form_sql(f's.{c}', kind)} END, 1, 50) AS value FROM x LEFT JOIN s ON s.{key} = k LEFT JOIN t ON t.{key} = k" for c, kind in list(kinds.items())[:columns]]
    return f"{_both_sql(name)}, x AS (SELECT * FROM (SELECT op, k, row_number() OVER (PARTITION BY op ORDER BY k) AS r FROM j WHERE op <> 'MATCH') WHERE r <= 5) SELECT op, CAST(r AS INTEGER) AS sample, k AS {key}, \"column\", value FROM ({' UNION ALL '.join(parts)})"


_of_table("sample_values", ("customer", "orders"), lambda s, d, n: report.sample_values(changes(s, d, n), [TABLES[n][0]], signed_zero=True), _sample_values_sql)
_of_table("changed_columns_first", ("orders",), lambda s, d, n: report.changed_columns(changes(s, d, n), [TABLES[n][0]], most=1, signed_zero=True), lambda n: f"SELECT {TABLES[n][0]}, column_name, old_value, new_value FROM (SELECT *, row_number() OVER (PARTITION BY {TABLES[n][0]} ORDER BY column_name) AS r FROM ({_changed_sql(n)})) WHERE r = 1")
add("has_differences", f"SELECT table_name, total_differences > 0 AS has_differences FROM ({_SUMMARY_SQL})")(lambda s, d: stats.has_differences(_summaries(s, d)).select("table_name", "has_differences"))
add("verification_rollup", "SELECT count(DISTINCT table_name) AS tables_verified, CAST(sum(n) AS BIGINT) AS total_valid FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS table_name, (SELECT count(*) FROM ({_verified_sql(n)} SELECT * FROM w WHERE verification_status = 'VALID')) AS n" for n in ("orders", "customer")) + ")")(lambda s, d: verify.verification_rollup(_verified(s, d, "orders").unionByName(_verified(s, d, "customer"))))
add("sync_script", " UNION ALL ".join(f"SELECT table_name, side, op_rank, op, '{{\"{TABLES[n][0]}\":' || {TABLES[n][0]} || '}}' AS primary_key, statement FROM ({_sync_sql(n, 'source')})" for n in ("nation", "supplier")))(lambda s, d: sqlgen.script({n: changes(s, d, n) for n in ("nation", "supplier")} | {"region": diff.diff(r := load(s, d, "region"), r, TableSpec("region", ("r_regionkey",)))}, {n: spec(n) for n in ("nation", "supplier")} | {"region": TableSpec("region", ("r_regionkey",))}, "source"))
add("run_events", f"SELECT event_type, message FROM (SELECT 'SESSION_START' AS event_type, 'tables: ' || count(*) AS message FROM ({_SUMMARY_SQL}) UNION ALL SELECT 'TABLE_COMPLETE', table_name || ' success' FROM ({_SUMMARY_SQL}) UNION ALL SELECT 'SESSION_END', 'failed: 0')")(lambda s, d: run.run_events(_summaries(s, d), "run").select("event_type", "message"))
_REPORTED = ("customer", "orders")
add("all_reports", "SELECT name, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"SELECT 'samples' AS name, (SELECT sum(least(c, 5)) FROM ({_both_sql(n)} SELECT count(*) AS c FROM j WHERE op <> 'MATCH' GROUP BY op)) AS n UNION ALL SELECT 'sample_values', (SELECT count(*) FROM ({_sample_values_sql(n)})) UNION ALL SELECT 'changed_columns', (SELECT count(*) FROM ({_changed_sql(n)})) UNION ALL SELECT 'summary_csv', 1 UNION ALL SELECT 'summary_json', 1" for n in _REPORTED) + ") GROUP BY name UNION ALL SELECT unnest(['run', 'totals']), 1")(lambda s, d: run.union_summaries([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in run.reports({n: changes(s, d, n) for n in _REPORTED}, run.union_summaries([run.compare_table(*sides(s, d, n), spec(n)) for n in _REPORTED]), {n: [TABLES[n][0]] for n in _REPORTED}, "run").items()]))
add("query_rows", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey")(lambda s, d: read_query(s, f"SELECT o_custkey, count(*) AS n FROM parquet.`{d}/orders.parquet` WHERE o_totalprice > :least GROUP BY o_custkey", args={"least": 100000}))
add("decimal_normal_form", r"SELECT p_partkey, regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(20,4)) AS VARCHAR), '\.?0+$', '') AS x FROM part")(lambda s, d: load(s, d, "part").select("p_partkey", decimal_text(F.col("p_retailprice").cast("decimal(20,4)")).alias("x")))
_FLAGS = ("YES", "n", "1", "0", "True", "perhaps")
add("flag_normal_form", "SELECT c_custkey, CASE WHEN c_custkey % 7 IN (0, 2, 4) THEN 'true' WHEN c_custkey % 7 < 6 THEN 'false' END AS x FROM customer")(lambda s, d: load(s, d, "customer").select("c_custkey", flag_text(F.coalesce(*[F.when(F.col("c_custkey") % 7 == i, v) for i, v in enumerate(_FLAGS)])).alias("x")))
add("base64_normal_form", "SELECT c_custkey, base64(encode(c_name)) AS x FROM customer")(lambda s, d: load(s, d, "customer").select("c_custkey", base64_text(F.col("c_name").cast("binary")).alias("x")))
add("literals", "SELECT o_orderkey, 'DATE ' || chr(39) || strftime(o_orderdate, '%Y-%m-%d') || chr(39) AS day, 'HEXTORAW(' || chr(39) || hex(encode(o_orderpriority)) || chr(39) || ')' AS bytes, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END AS flag, 'N' || chr(39) || o_orderstatus || chr(39) AS status, chr(39) || base64(encode(o_orderstatus)) || chr(39) AS other_bytes FROM orders")(lambda s, d: load(s, d, "orders").withColumns({"b": F.col("o_orderpriority").cast("binary"), "c": F.col("o_orderstatus").cast("binary"), "day_": F.to_date("o_orderdate"), "even": F.col("o_orderkey") % 2 == 0}).select("o_orderkey", *[literal(F.col(c), t, tag, dialect).alias(out) for c, t, tag, dialect, out in (("day_", T.DateType(), None, "oracle", "day"), ("b", T.BinaryType(), None, "oracle", "bytes"), ("even", T.BooleanType(), None, "oracle", "flag"), ("o_orderstatus", T.StringType(), "nvarchar", "oracle", "status"), ("c", T.BinaryType(), None, "ansi", "other_bytes"))]))
add("text_lengths", "SELECT doc_id, coalesce(length(text) <= 4000, TRUE) AS fits FROM documents")(lambda s, d: (x := load(s, d, "documents").select("doc_id", F.struct("text", "lang").alias("row"))).select("doc_id", checks.strings_fit("row", x.schema["row"].dataType).alias("fits")))
add("audit_progress", "SELECT 's' || (user_id % 10) AS session_id, ts AS timestamp, round(100.0 * CAST(event_id % 9 AS DOUBLE) / 8, 2) AS percentage FROM events WHERE event_type = 'view'")(lambda s, d: audit.progress(load(s, d, "events").where("event_type = 'view'").select(F.concat(F.lit("s"), F.col("user_id") % 10).alias("session_id"), F.col("ts").alias("timestamp"), F.lit("BATCH_PROGRESS").alias("event_type"), F.to_json(F.struct((F.col("event_id") % 9).alias("batch_number"), F.lit(8).alias("total_batches"))).alias("details"))))
add("audit_retained", f"{_E} SELECT session_id, event_type, message FROM e WHERE timestamp >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAY")(lambda s, d: audit.retained(audit_events(s, d), 10, "2024-01-20 00:00:00").select("session_id", "event_type", "message"))
_VENDOR = {"VARCHAR2(30)": ("varchar", "character"), "Number(10, 2)": ("numeric", "numeric"), "TIMESTAMP(6) WITH TIME ZONE": ("timestamp_tz", "datetime"), "long raw": ("long_binary", "binary"), "INTERVAL DAY(2) TO SECOND(6)": ("interval_ds", "interval"), "XMLType": ("xml", "special"), "geometry": ("unknown", "unknown")}
add("vendor_types", "SELECT p_partkey, CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _) in enumerate(_VENDOR.values())) + " END AS standard_type, CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (_, c) in enumerate(_VENDOR.values())) + " END AS category FROM part")(lambda s, d: checks.map_vendor_types(load(s, d, "part").select("p_partkey", F.coalesce(*[F.when(F.col("p_partkey") % 7 == i, v) for i, v in enumerate(_VENDOR)]).alias("data_type"))).select("p_partkey", "standard_type", "category"))

# ---------------------------------------------------------------- limited, resumed and stored work


def _resumed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A comparison that stops after some waves and is taken up again."""
    a, b, path = *sides(spark, d, name), folder(spark)
    resumable_diff(a, b, spec(name), path, rows=5000, size=2, most=1)
    return resumable_diff(a, b, spec(name), path, rows=5000, size=2)


def _merged(spark: SparkSession, d: str, name: str, partition: str) -> DataFrame:
    """The drifted copy stored by `partition`, after its change set is merged into it."""
    df, path = load(spark, d, name), folder(spark)
    old = drifted(df, name)
    old.write.partitionBy(partition).parquet(path)
    merge_changes(spark, path, diff.diff(df, spark.read.parquet(path), spec(name)), [TABLES[name][0]], partition)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Events of the store, by day, after its retention."""
    path = folder(spark)
    events.append_to_store(audit_events(spark, d), path)
    events.retain(spark, path, 10, datetime(2024, 1, 20, 12))
    return events.stored_events(spark, path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    """The audit rows that a run over all tables has written."""
    path = folder(spark)
    run.recorded_run(spark, [(spec(n), lambda n=n: load(spark, d, n), lambda n=n: drifted(load(spark, d, n), n)) for n in RUN], path, "run")
    return events.stored_events(spark, f"{path}/events").select("event_type", "message")


_diff_sql = lambda n: SQL[f"diff_changes_{n}"]
_of_table("diff_by_tree", ("orders", "customer", "part"), lambda s, d, n: tree.tree_diff(*sides(s, d, n), spec(n), rows=500).select("op", TABLES[n][0], "source_hash", "target_hash"), _diff_sql)
_of_table("diff_resumed", ("orders",), lambda s, d, n: _resumed(s, d, n).select("op", TABLES[n][0], "source_hash", "target_hash"), _diff_sql)
_of_table("merge_changes", ("orders",), lambda s, d, n: _merged(s, d, n, TABLES[n][3]), lambda n: f"SELECT * FROM {n}")
add("event_store", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' GROUP BY 1")(_stored)
add("recorded_run", SQL["run_events"])(_recorded)
_changed_keys = lambda n, ops: f"{_both_sql(n)} SELECT k FROM j WHERE op IN ({ops})"
add("change_unique_violations", f"SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer WHERE (c_mktsegment, c_nationkey) IN (SELECT (c_mktsegment, c_nationkey) FROM customer WHERE c_custkey IN ({_changed_keys('customer', chr(39) + 'INSERT' + chr(39) + ', ' + chr(39) + 'UPDATE' + chr(39))})) GROUP BY ALL HAVING count(*) > 1")(lambda s, d: constraints.unique_violations(once(changes(s, d, "customer")), drifted(load(s, d, "customer"), "customer"), ["c_custkey"], ["c_mktsegment", "c_nationkey"]))
add("change_orphans", f"WITH p AS ({_drift_sql('customer')}) SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN ({_changed_keys('orders', chr(39) + 'INSERT' + chr(39) + ', ' + chr(39) + 'UPDATE' + chr(39))}) AND o_custkey NOT IN (SELECT c_custkey FROM p)")(lambda s, d: constraints.parent_violations(once(changes(s, d, "orders")), c := load(s, d, "customer"), [("o_custkey", "c_custkey")], once(diff.diff(drifted(c, "customer"), c, spec("customer"))), ["c_custkey"]).select("o_orderkey", "o_custkey"))
add("change_children", f"WITH p AS ({_drift_sql('customer')}) SELECT o_custkey AS c_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_custkey NOT IN (SELECT c_custkey FROM p) GROUP BY 1")(lambda s, d: constraints.child_violations(once(diff.diff(drifted(c := load(s, d, "customer"), "customer"), c, spec("customer"))), c, ["c_custkey"], load(s, d, "orders"), [("o_custkey", "c_custkey")]))

# ---------------------------------------------------------------- written and read again, dictionary views, intervals


def _events_file(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    io.append_events(audit_events(spark, d).where("event_type = 'ERROR'"), path)
    io.append_events(audit_events(spark, d).where("event_type <> 'ERROR'"), path)
    return io.read_events(spark, path).select("session_id", "event_type", "timestamp", "message")


def _script_files(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = folder(spark)
    io.write_scripts(sqlgen.statements(changes(spark, d, name), spec(name)), path, [TABLES[name][0]])
    return spark.read.schema("value string, table_name string, side string").text(path).select("table_name", "side", F.col("value").alias("statement"))


def _summary_file(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    io.write_csv(report.csv_summary(_summaries(spark, d)), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("Table Name").alias("table_name"), F.col("Status").alias("status"), F.col("Total Differences").cast("long").alias("total_differences"), F.col("Match Percentage").cast("double").alias("match_percentage"))


def _summary_json(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    io.write_json(report.json_report(_summaries(spark, d), "r1"), path)
    back = spark.read.schema("run_id string, table_name string, result struct<total_differences: long, match_percentage: double>").json(path)
    return back.select("run_id", "table_name", "result.*")


def _key_columns(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary views as large as the tables: a constraint an order, its columns the order's lines."""
    constraints_ = load(spark, d, "orders").select(F.lit("MAIN").alias("owner"), F.col("o_orderkey").alias("constraint_name"), F.when(F.col("o_orderstatus") == "F", "P").otherwise("R").alias("constraint_type"))
    columns = load(spark, d, "lineitem").select(F.lit("MAIN").alias("owner"), F.col("l_orderkey").alias("constraint_name"), F.concat(F.lit("T"), F.col("l_orderkey")).alias("table_name"), F.concat(F.lit("C"), F.col("l_partkey")).alias("column_name"), F.col("l_linenumber").alias("position"))
    return io.primary_keys(constraints_, columns)


add("events_file", f"{_E} SELECT session_id, event_type, timestamp, message FROM e")(_events_file)
_of_table("script_files", ("supplier",), _script_files, lambda n: f"SELECT table_name, side, statement FROM ({_sync_sql(n, 'target')})")
add("summary_file", f"SELECT table_name, 'SUCCESS' AS status, total_differences, match_percentage FROM ({_SUMMARY_SQL})")(_summary_file)
add("summary_json", f"SELECT 'r1' AS run_id, table_name, total_differences, match_percentage FROM ({_SUMMARY_SQL})")(_summary_json)
add("key_columns", "SELECT 'MAIN' AS owner, 'T' || l_orderkey AS table_name, 'C' || l_partkey AS column_name, l_linenumber AS position FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")(_key_columns)
add("interval_normal_form", "SELECT o_orderkey, 'INTERVAL ''' || (o_orderkey % 40) || ' ' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00:' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || ''' DAY TO SECOND' AS ds, 'INTERVAL ''' || (o_orderkey % 9) || '-' || (o_custkey % 12) || ''' YEAR TO MONTH' AS ym FROM orders")(lambda s, d: load(s, d, "orders").select("o_orderkey", F.make_dt_interval(F.col("o_orderkey") % 40, F.col("o_orderkey") % 24, F.lit(0), (F.col("o_custkey") % 60).cast("decimal(18,6)")).alias("ds"), F.make_ym_interval(F.col("o_orderkey") % 9, F.col("o_custkey") % 12).alias("ym")).select("o_orderkey", normalize(F.col("ds"), T.DayTimeIntervalType()).alias("ds"), normalize(F.col("ym"), T.YearMonthIntervalType()).alias("ym")))
