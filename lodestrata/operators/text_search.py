"""Text search: case-insensitive substrings, ranked per file (F1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_HITS = 5
CONTEXT = 1


def strip(text: Column) -> Column:
    """Without white space at both ends, of whatever script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def line_hits(files: DataFrame, text: str, key: str = "path", max_hits: int = MAX_HITS, context: int = CONTEXT) -> DataFrame:
    """(key, line, content, context) of the first hits of each file in the order of its lines.

    line is 1-based, content the stripped line, context the lines around it. Files without the text are dropped before their
    lines are made; context is cut out of the line array, so no window over lines is needed.
    """
    wanted = text.lower()
    lines = F.split("content", "\n", -1)
    matched = F.filter(F.transform(lines, lambda l, i: F.struct((i + 1).alias("line"), l.alias("text"))), lambda s: F.lower(s["text"]).contains(wanted))
    return (
        files.where(F.lower("content").contains(wanted))
        .select(key, lines.alias("lines"), F.explode(F.slice(matched, 1, max_hits)).alias("hit"))
        .select(
            key,
            F.col("hit.line").alias("line"),
            strip(F.col("hit.text")).alias("content"),
            F.array_join(F.slice("lines", F.greatest(F.col("hit.line") - context, F.lit(1)), F.least(F.col("hit.line"), F.lit(context + 1)) + context), "\n").alias("context"),
        )
    )


def score(n_hits: Column, n_lines: Column) -> Column:
    """0.7 for the hits, at most five, and up to 0.3 for short files."""
    return 0.7 * F.least(n_hits / 5.0, F.lit(1.0)) + 0.3 / (1.0 + n_lines / 1000.0)


def search(files: DataFrame, text: str, key: str = "path", limit: int = 50) -> DataFrame:
    """(key, n_hits, first_line, score): the best files, ties by key. Each file is read once, nothing is exploded or shuffled
    but the top rows."""
    wanted = text.lower()
    lines = F.split("content", "\n", -1)
    numbered = F.transform(lines, lambda l, i: F.when(F.lower(l).contains(wanted), i + 1))
    hits = F.array_compact(numbered)
    return (
        files.where(F.lower("content").contains(wanted))
        .select(key, F.least(F.size(hits), F.lit(MAX_HITS)).alias("n_hits"), F.try_element_at(hits, F.lit(1)).alias("first_line"), F.size(lines).alias("n_lines"))
        .where("n_hits > 0")
        .withColumn("score", F.round(score(F.col("n_hits"), F.col("n_lines")), 6))
        .drop("n_lines")
        .orderBy(F.col("score").desc(), key)
        .limit(limit)
    )


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps only k per group before the shuffle."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")
