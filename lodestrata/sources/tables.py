"""Readers of the parquet tables and the views of them that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_EVENTS = ("add", "change", "unlink")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def newest(value: Column | str, *order: Column | str) -> Column:
    """Aggregate: the value of the row that is greatest by ``order``, nulls in ``value`` left out."""
    value = F.col(value) if isinstance(value, str) else value
    return F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.struct(*order)))


def latest_contents(file_changes: DataFrame) -> DataFrame:
    """One row per path: (path, content, change_id, last_event).

    ``content`` and ``change_id`` are those of the non-null content with the greatest ts (ties: the
    greatest change_id), null if no event of the path carries content. ``last_event`` is the type of the
    last add, change or unlink, null if there is none. Rows with a null path are left out. Duplicate and
    late rows do not matter, because only the greatest (ts, change_id) counts. One aggregate with a
    map-side part: of a path with many versions each map task ships one.
    """
    is_event = F.col("event_type").isin(*FILE_EVENTS)
    order = F.struct("ts", "change_id")
    has_text = F.col("content").isNotNull()
    return (
        file_changes.where(F.col("path").isNotNull())
        .groupBy("path")
        .agg(
            F.max_by(F.struct("content", "change_id"), F.when(has_text, order)).alias("newest"),
            F.max_by("event_type", F.when(is_event, order)).alias("last_event"),
            F.max(has_text).alias("has_text"),
        )
        .select(
            "path",
            F.when(F.col("has_text"), F.col("newest.content")).alias("content"),
            F.when(F.col("has_text"), F.col("newest.change_id")).alias("change_id"),
            "last_event",
        )
    )


def current_contents(file_changes: DataFrame) -> DataFrame:
    """(path, content, change_id) of the paths with content whose last file event is not an unlink."""
    return latest_contents(file_changes).where(
        F.col("content").isNotNull() & F.col("last_event").isNotNull() & (F.col("last_event") != "unlink")
    ).drop("last_event")


def path_extension(path: Column) -> Column:
    """Lower-case extension of the last path segment, '' if it has none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def path_repository(path: Column) -> Column:
    """The first path segment."""
    return F.substring_index(path, "/", 1)
