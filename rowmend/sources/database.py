"""Database tables read in even key ranges, and statements applied to a database exactly once."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowmend.operators.store import kept, release

# ---------------------------------------------------------------- reading


@dataclass(frozen=True)
class Reading:
    """How a table is read: one predicate a partition, and the snapshot point that all of them share."""

    relation: str
    predicates: list[str]
    point: Any = None
    columns: tuple[str, ...] = ("*",)


def sql_value(value: Any) -> str:
    """A value as SQL text that JDBC drivers understand; dates and timestamps in JDBC's own escapes."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, datetime.datetime):
        return f"{{ts '{value:%Y-%m-%d %H:%M:%S.%f}'}}"
    if isinstance(value, datetime.date):
        return f"{{d '{value:%Y-%m-%d}'}}"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def _after(keys: list[str], bound: list[str]) -> str:
    """Keys from `bound` on, in the order of the database."""
    k, b = keys[0], bound[0]
    return f"{k} >= {b}" if len(keys) == 1 else f"({k} > {b} OR ({k} = {b} AND {_after(keys[1:], bound[1:])}))"


def _before(keys: list[str], bound: list[str]) -> str:
    k, b = keys[0], bound[0]
    return f"{k} < {b}" if len(keys) == 1 else f"({k} < {b} OR ({k} = {b} AND {_before(keys[1:], bound[1:])}))"


def range_predicates(keys: list[str], bounds: list[tuple], not_null: bool = False) -> list[str]:
    """Predicates of the ranges between `bounds` (first keys of all ranges but the first), which hold every row once.

    Rows with a null in a key column make a range of their own, unless `not_null` vouches for the keys.
    """
    lows = [[sql_value(v) for v in b] for b in bounds]
    out = []
    for lo, hi in zip([None, *lows], [*lows, None], strict=True):
        parts = [_after(keys, lo)] if lo else []
        parts += [_before(keys, hi)] if hi else []
        # The leading column alone, as well: what an index is looked up by.
        parts += [f"{keys[0]} >= {lo[0]}"] if lo and len(keys) > 1 else []
        parts += [f"{keys[0]} <= {hi[0]}"] if hi and len(keys) > 1 else []
        parts += [] if not_null else [f"{k} IS NOT NULL" for k in keys]
        out.append(" AND ".join(parts) or "1 = 1")
    return out if not_null else [*out, " OR ".join(f"{k} IS NULL" for k in keys)]


def plan_reading(spark: SparkSession, url: str, table: str, keys: list[str], rows: int = 1_000_000, where: str | None = None, columns: list[str] | None = None, point_query: str | None = None, at_point: str = "{table}", not_null: bool = False, numbering: str = "ROW_NUMBER() OVER (ORDER BY {keys})", **options: Any) -> Reading:
    """Ranges of `rows` rows by position in key order: skewed, composite and text keys are dealt evenly, in one query.

    `point_query` fetches a snapshot point once; `at_point` says how a table is read at it, for the ranges and for all
    partitions alike: `{table} AS OF SCN {point}`, or a derived table with a filter on a version column. `numbering`: for
    databases that number an ordered derived table (then `ROW_NUMBER() OVER ()`). Rows that come in after the planning
    are still read, in the range that their keys fall in, unless the snapshot leaves them out.
    """
    ask = lambda text: spark.read.format("jdbc").options(url=url, query=text, **options).load()
    point = ask(point_query).first()[0] if point_query else None
    source = at_point.format(table=table, point=sql_value(point))
    chosen, held = ", ".join(keys), f" WHERE {where}" if where else ""
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    inner = f"SELECT {chosen} FROM {source}{held + ' AND ' if held else ' WHERE '}{known}"
    if "ORDER BY" not in numbering:
        inner += f" ORDER BY {chosen}"
    numbered = f"SELECT {chosen}, {numbering.format(keys=chosen)} AS rn FROM ({inner}) o"
    at = f"rn > 1 AND MOD(rn, {int(rows)}) = 1" if rows > 1 else "rn > 1"
    firsts = ask(f"SELECT {chosen}, rn FROM ({numbered}) n WHERE {at}").collect()  # one row a range
    bounds = list(dict.fromkeys(tuple(r)[:-1] for r in sorted(firsts, key=lambda r: r[-1])))
    return Reading(f"(SELECT * FROM {source}{held}) q", range_predicates(keys, bounds, not_null), point, tuple(columns or ("*",)))


def read_ranges(spark: SparkSession, url: str, reading: Reading, **options: Any) -> DataFrame:
    """The table in as many partitions as the plan has ranges, each by a query of its own, for the columns that are used."""
    whole = spark.read.jdbc(url, reading.relation, predicates=reading.predicates, properties={k: str(v) for k, v in options.items()})
    return whole.select(*reading.columns)


# ---------------------------------------------------------------- applying

LEDGER = "run_id VARCHAR(200) NOT NULL, part INTEGER NOT NULL, batch INTEGER NOT NULL, statements INTEGER NOT NULL, affected INTEGER NOT NULL, digest VARCHAR(64) NOT NULL, PRIMARY KEY (run_id, part, batch)"


class OtherStatementsError(ValueError):
    """A run id was used before, with other statements."""


def create_ledger(connect: Callable[[], Any], table: str = "applied_batches") -> None:
    """Create the ledger in the database that is changed. It must lie there: it shares the transactions of the batches."""
    connection = connect()
    try:
        connection.cursor().execute(f"CREATE TABLE {table} ({LEDGER})")
        connection.commit()
    finally:
        connection.close()


def apply_batch(connection: Any, run_id: str, part: int, batch: int, texts: list[str], table: str) -> tuple[int, int, bool]:
    """(statements, affected rows, whether they were applied before): a batch and its ledger row in one transaction.

    The ledger row goes first: of two tasks with one batch the second waits for it or fails at the ledger's key, and then
    finds the batch done.
    """
    digest, key = hashlib.sha256("\0".join(texts).encode()).hexdigest(), f"run_id = '{run_id}' AND part = {part} AND batch = {batch}"
    cursor = connection.cursor()

    def before() -> tuple[int, int, bool] | None:
        cursor.execute(f"SELECT statements, affected, digest FROM {table} WHERE {key}")
        row = cursor.fetchone()
        if row and row[2] != digest:
            raise OtherStatementsError(f"run {run_id} has applied other statements as batch {batch} of part {part}")
        return (row[0], row[1], True) if row else None

    try:
        if done := before():
            connection.rollback()
            return done
        try:
            cursor.execute(f"INSERT INTO {table} (run_id, part, batch, statements, affected, digest) VALUES ('{run_id}', {part}, {batch}, {len(texts)}, 0, '{digest}')")
        except Exception:
            connection.rollback()
            if done := before():
                return done
            raise
        affected = 0
        for text in texts:
            cursor.execute(text.rstrip().removesuffix(";"))
            affected += max(cursor.rowcount, 0)
        cursor.execute(f"UPDATE {table} SET affected = {affected} WHERE {key}")
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    return len(texts), affected, False


def batched(statements: DataFrame, parts: int, size: int) -> DataFrame:
    """(part, batch, statement) with `op_rank` as the leading digits of the part: the same rows get the same batches.

    The order is that of the statement texts, which are counted if they repeat, so it doesn't depend on how Spark deals rows.
    """
    rank = F.col("op_rank") if "op_rank" in statements.columns else F.lit(0)
    dealt = statements.select((rank * parts + F.pmod(F.xxhash64("statement"), F.lit(parts))).cast("int").alias("part"), "statement")
    number = F.row_number().over(Window.partitionBy("part").orderBy("statement"))
    return dealt.withColumn("batch", F.floor((number - 1) / size).cast("int"))


def apply_once(statements: DataFrame, connect: Callable[[], Any], run_id: str, batch: int = 1000, parts: int = 8, ledger: str = "applied_batches") -> DataFrame:
    """Run each statement exactly once under `run_id`; (part, batch, statements, affected, applied_before) of all batches.

    The batches are saved first, so that a task that is retried, or that runs twice at once, takes the same ones. Every batch
    is committed together with its ledger row; a batch with a row is skipped. Called again under the same `run_id` after
    a failure, it goes on where it stopped. With `op_rank`, all deletes come before all inserts and these before all updates.
    A failing statement undoes its batch and ends the run.
    """
    if not re.fullmatch(r"[\w.:-]{1,200}", run_id):
        raise ValueError("a run id has up to 200 letters, digits and . : - _")
    saved = kept(batched(statements, parts, batch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        connection = connect()
        try:
            rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
            for (part, number), group in groupby(rows, key=lambda r: r[:2]):
                n, affected, before = apply_batch(connection, run_id, part, number, [r[2] for r in group], ledger)
                yield pa.RecordBatch.from_pylist([{"part": part, "batch": number, "statements": n, "affected": affected, "applied_before": before}], schema=REPORT)
        finally:
            connection.close()

    out = None
    for rank in sorted(r[0] for r in saved.select(F.floor(F.col("part") / parts)).distinct().collect()):  # 3 at most
        some = saved.where(F.floor(F.col("part") / parts) == rank)
        dealt = some.select("part", "batch", "statement").repartition(parts, "part").sortWithinPartitions("part", "batch", "statement")
        done = kept(dealt.mapInArrow(run, "part int, batch int, statements int, affected int, applied_before boolean"))
        out = done if out is None else out.unionByName(done)
    release(saved)
    return out if out is not None else statements.sparkSession.createDataFrame([], "part int, batch int, statements int, affected int, applied_before boolean")


REPORT = pa.schema([("part", pa.int32()), ("batch", pa.int32()), ("statements", pa.int32()), ("affected", pa.int32()), ("applied_before", pa.bool_())])
