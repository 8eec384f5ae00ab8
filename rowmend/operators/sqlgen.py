"""Synchronisation statements from a change set, in both directions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmend.functions.literals import identifier, literal
from rowmend.operators.diff import reverse
from rowmend.spec import TableSpec


def _where(row: str, schema: T.StructType, keys: list[str], tags: dict[str, str], dialect: str) -> Column:
    parts = []
    for k in keys:
        c = F.col(f"{row}.`{k}`")
        parts.append(F.when(c.isNull(), f"{identifier(k)} IS NULL").otherwise(F.concat(F.lit(f"{identifier(k)} = "), literal(c, schema[k].dataType, tags.get(k), dialect))))
    return F.concat_ws(" AND ", *parts)


def statements(changes: DataFrame, spec: TableSpec, side: str = "target", dialect: str = "oracle") -> DataFrame:
    """(table_name, side, op_rank, op, keys, statement); deletes come first, then inserts, then updates.

    side `target`: make target equal source; side `source`: the reverse.
    """
    changes = changes if side == "target" else reverse(changes)
    schema, tags = changes.schema["source_data"].dataType, spec.tags
    keys = [k for k in changes.columns if k.lower() in {x.lower() for x in spec.keys}]
    table = f"{identifier(spec.schema)}.{identifier(spec.name)}"
    names = [f.name for f in schema]
    text = {f.name: literal(F.col(f"source_data.`{f.name}`"), f.dataType, tags.get(f.name), dialect) for f in schema}
    sets = [F.concat(F.lit(f"{identifier(n)} = "), text[n]) for n in names if n not in keys]
    insert = F.concat(F.lit(f"INSERT INTO {table} ({', '.join(map(identifier, names))}) VALUES ("), F.concat_ws(", ", *text.values()), F.lit(");"))
    update = F.concat(F.lit(f"UPDATE {table} SET "), F.concat_ws(", ", *sets), F.lit(" WHERE "), _where("source_data", schema, keys, tags, dialect), F.lit(";"))
    delete = F.concat(F.lit(f"DELETE FROM {table} WHERE "), _where("target_data", schema, keys, tags, dialect), F.lit(";"))
    op = F.col("op")
    rank = F.when(op == "DELETE", 0).when(op == "INSERT", 1).otherwise(2)
    made = F.when(op == "INSERT", insert).when(op == "DELETE", delete).otherwise(update)
    return changes.select(F.lit(spec.name).alias("table_name"), F.lit(side).alias("side"), rank.alias("op_rank"), "op", *keys, made.alias("statement"))


def script(changes: dict[str, DataFrame], specs: dict[str, TableSpec], side: str = "target", dialect: str = "oracle") -> DataFrame:
    """(table_name, side, op_rank, op, primary_key as JSON, statement) of several tables; a table without changes adds nothing."""
    parts = []
    for name, df in changes.items():
        made = statements(df, specs[name], side, dialect)
        keys = [c for c in made.columns if c not in ("table_name", "side", "op_rank", "op", "statement")]
        parts.append(made.select("table_name", "side", "op_rank", "op", F.to_json(F.struct(*keys)).alias("primary_key"), "statement"))
    return reduce(DataFrame.unionByName, parts)


def ordered(made: DataFrame, keys: list[str]) -> DataFrame:
    return made.orderBy("table_name", "side", "op_rank", *keys)
