"""Reading tables from databases and files, and writing scripts, reports, events and changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rowmend.operators.audit import EVENT


def read_table(spark: SparkSession, source: str, kind: str = "parquet", **options: Any) -> DataFrame:
    """A table from files (parquet, orc, csv, json), the catalog (`table`) or a database (`jdbc`: url as `source`)."""
    if kind == "table":
        return spark.table(source)
    if kind == "jdbc":
        return spark.read.format("jdbc").options(url=source, **{k: str(v) for k, v in options.items()}).load()
    return spark.read.format(kind).options(**options).load(source)


def read_query(spark: SparkSession, query: str, url: str | None = None, args: dict[str, Any] | None = None, **options: Any) -> DataFrame:
    """The rows of a query: Spark SQL, or pushed to a database where `url` is given."""
    if url:
        return spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return spark.sql(query, args=args) if args else spark.sql(query)


def jdbc_table_exists(spark: SparkSession, url: str, dictionary: str, schema: str, table: str, **options: Any) -> bool:
    """Looks the table up, in any case, in a dictionary view with owner and table_name."""
    found = spark.read.format("jdbc").options(url=url, dbtable=dictionary, **options).load()
    names = {c.lower(): c for c in found.columns}
    return not found.where((F.lower(names["owner"]) == schema.lower()) & (F.lower(names["table_name"]) == table.lower())).isEmpty()


def primary_keys(constraints: DataFrame, columns: DataFrame) -> DataFrame:
    """Key columns in order from two dictionary views, joined on owner and constraint name."""
    both = constraints.where("constraint_type = 'P'").join(columns, ["owner", "constraint_name"])
    return both.select("owner", columns["table_name"], "column_name", "position").orderBy("owner", "table_name", "position")


def metadata(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """Columns of a dictionary view (owner, table_name, column_name) with key_position, null where not in the primary key."""
    on = ["owner", "table_name", "column_name"]
    return columns.join(keys.select(*on, F.col("position").alias("key_position")), on, "left")


def write_scripts(statements: DataFrame, path: str, keys: list[str]) -> None:
    """One folder a table and side; statements in order of deletes, inserts, updates and keys."""
    ready = statements.repartitionByRange("table_name", "side", "op_rank", *keys).sortWithinPartitions("table_name", "side", "op_rank", *keys)
    ready.select("table_name", "side", "statement").write.partitionBy("table_name", "side").mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Add events as JSON lines, with microseconds (Spark's own format would cut them)."""
    events.write.mode("append").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Audit events from JSON lines; malformed lines are skipped."""
    rows = spark.read.text(path)
    parsed = rows.select(F.from_json("value", EVENT).alias("e"), "value")
    return parsed.where(F.col("e.event_type").isNotNull()).select("e.*")


def apply_to_database(statements: DataFrame, connect: Callable[[], Any], batch: int = 1000) -> None:
    """Run statements through a DB-API connection of each task, in transactions of at most `batch` statements.

    A statement that fails rolls its batch back and stops the job; batches before it stay, and a retried task runs them
    again: `database.apply_once` keeps a ledger and doesn't.
    """

    def run(rows: Iterator[Row]) -> None:
        connection = connect()
        try:
            cursor = connection.cursor()
            while part := list(islice(rows, batch)):
                for row in part:
                    cursor.execute(row["statement"].rstrip(";"))
                connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    statements.foreachPartition(run)
