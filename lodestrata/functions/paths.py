"""Path expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """Trimmed, '/' as separator, empty and '.' segments dropped and '..' resolved; case is kept.

    A '..' without a segment before it is dropped; null stays null, a path without segments gives ''.
    """
    blank = r"^[\s ]+|[\s ]+$"
    parts = F.split(F.translate(F.regexp_replace(path, blank, ""), "\\", "/"), "/", -1)
    kept = F.filter(parts, lambda s: ~s.isin("", "."))
    simple = F.array_join(kept, "/")
    resolved = F.aggregate(
        kept,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.array_append(acc, s)
        ),
        lambda acc: F.array_join(acc, "/"),
    )
    return F.when(F.array_contains(kept, ".."), resolved).otherwise(simple)
