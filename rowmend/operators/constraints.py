"""Constraints of a change set: what would be violated once it is applied, found from the changed rows alone.

Only inserted, updated and deleted values meet the table, its parents and its children, by semi and anti joins in which the
change set is the small side; rows that the change set doesn't touch aren't checked among themselves. A violation that was
there before and that no changed row takes part in isn't reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmend.operators.diff import same_key
from rowmend.operators.store import small


def _known(columns: list[str], side: str = "") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{side}`{c}`").isNotNull() for c in columns])


def _equal(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"s.`{a}`") == F.col(f"t.`{b}`") for a, b in zip(left, right, strict=True)])


def new_rows(changes: DataFrame) -> DataFrame:
    return changes.where("op <> 'DELETE'").select("source_data.*")


def untouched(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the table that the change set neither deletes nor updates."""
    return table.alias("s").join(small(changes.where("op <> 'INSERT'").select(*keys)).alias("t"), same_key(keys), "left_anti")


def unique_violations(changes: DataFrame, table: DataFrame, keys: list[str], unique: list[str]) -> DataFrame:
    """(unique columns, n) for values of changed rows that more than one row would hold; values with a null never clash.

    changes: kept by `once`, as several joins read it.
    """
    new = new_rows(changes).select(*unique).where(_known(unique))
    wanted = new.distinct()
    held = table.select(*dict.fromkeys([*keys, *unique])).where(_known(unique))
    met = held.alias("s").join(small(wanted).alias("t"), _equal(unique, unique), "left_semi")
    rest = untouched(met, changes, keys).select(*unique)
    return rest.unionByName(new).groupBy(*unique).agg(F.count("*").alias("n")).where("n > 1")


def parent_violations(changes: DataFrame, parent: DataFrame, on: list[tuple[str, str]], parent_changes: DataFrame | None = None, parent_keys: list[str] | None = None) -> DataFrame:
    """Inserted and updated rows whose foreign key isn't null and finds no parent, after the parents' own changes if given."""
    child, held = [c for c, _ in on], [p for _, p in on]
    new = new_rows(changes).where(_known(child))
    wanted = small(new.select(*child).distinct())
    if parent_changes is not None:
        kept = untouched(parent.select(*dict.fromkeys([*parent_keys, *held])), parent_changes, parent_keys).select(*held)
        parent = kept.unionByName(new_rows(parent_changes).select(*held))
    there = parent.select(*held).alias("s").join(wanted.alias("t"), _equal(held, child), "left_semi").distinct()
    return new.alias("s").join(there.alias("t"), _equal(child, held), "left_anti")


def child_violations(changes: DataFrame, table: DataFrame, keys: list[str], child: DataFrame, on: list[tuple[str, str]], child_changes: DataFrame | None = None, child_keys: list[str] | None = None) -> DataFrame:
    """(parent columns, n): values that deleted or updated rows held, that no row will hold, and that n child rows still refer to.

    on: (child column, parent column) pairs; the children's own changes are taken into account if given.
    """
    refers, held = [c for c, _ in on], [p for _, p in on]
    lost = changes.where("op <> 'INSERT'").select("target_data.*").select(*held).where(_known(held)).distinct()
    coming = new_rows(changes).select(*held)
    others = table.select(*dict.fromkeys([*keys, *held])).alias("s").join(small(lost).alias("t"), _equal(held, held), "left_semi")
    stays = untouched(others, changes, keys).select(*held).unionByName(coming).distinct()
    gone = lost.alias("s").join(stays.alias("t"), _equal(held, held), "left_anti")
    if child_changes is not None:
        kept = untouched(child.select(*dict.fromkeys([*child_keys, *refers])), child_changes, child_keys).select(*refers)
        child = kept.unionByName(new_rows(child_changes).select(*refers))
    left = child.select(*refers).alias("s").join(small(gone).alias("t"), _equal(refers, held), "left_semi")
    return left.groupBy(*[F.col(f"`{c}`").alias(p) for c, p in on]).agg(F.count("*").alias("n"))
