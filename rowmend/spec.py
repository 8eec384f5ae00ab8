"""What to compare: the keys of a table, its filter, its excluded columns and how rows are fingerprinted."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TableSpec:
    """`where` filters both sides alike; `exclude` names columns in any case.

    encoding: `compat` joins `column:value` texts by `|`, with nulls as NULL and a negative float zero as -0; `safe` marks nulls and prefixes lengths, so
    no two different rows share a text. duplicates: what to do with keys that occur more than once on one side: `error`
    raises when the result is computed, `unique` trusts that there are none, `exclude` leaves all their rows out, `first` keeps the row with the smallest digest.
    """

    name: str
    keys: tuple[str, ...]
    where: str | None = None
    exclude: tuple[str, ...] = ()
    algorithm: str = "sha256"
    encoding: str = "safe"
    duplicates: str = "error"
    tags: dict[str, str] = field(default_factory=dict)  # column -> clob, json, flag, date, time
    schema: str = "MAIN"
