"""Row texts and digests over normal forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_text(forms: Sequence[tuple[str, Column]], encoding: str = "safe") -> Column:
    """Text of a row from (name, normal form) pairs in the order given."""
    if not forms:
        return F.lit("")
    if encoding == "compat":
        return F.concat_ws("|", *[F.concat(F.lit(f"{n}:"), F.coalesce(c, F.lit("NULL"))) for n, c in forms])
    return F.concat(*[F.when(c.isNull(), F.lit("N;")).otherwise(F.concat(F.lit("V"), F.length(c).cast("string"), F.lit(":"), c)) for _, c in forms])


def digest(text: Column, algorithm: str = "sha256") -> Column:
    """Lower-case hexadecimal md5, sha1 or sha256; an unknown algorithm means sha256."""
    name = algorithm.lower()
    return F.md5(text.cast("binary")) if name == "md5" else F.sha1(text.cast("binary")) if name == "sha1" else F.sha2(text.cast("binary"), 256)
