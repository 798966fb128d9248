"""What the queries share: tables as relations of the operators, and the same relations in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.languages import detect_language
from lodestrata.operators import rules
from lodestrata.sources.tables import current_contents, table

Query = Callable[[SparkSession, str], DataFrame]


def source(spark: SparkSession, directory: str) -> DataFrame:
    """(path, language, content) of the files that exist with content."""
    return current_contents(table(spark, directory, "file_changes")).select("path", detect_language(F.col("path")).alias("language"), "content")


def documents(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as files: (doc_id, content, lang)."""
    return table(spark, directory, "documents").select("doc_id", F.col("text").alias("content"), "lang")


def symbols(spark: SparkSession, directory: str) -> DataFrame:
    """One row per symbol, with its path."""
    return table(spark, directory, "symbols").withColumnRenamed("file_path", "path").dropDuplicates(["symbol_id"])


def distinct(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """The id and the columns of a table's different rows; only these are read and compared. Rows that share an id are equal."""
    return table(spark, directory, name).select("id", *columns).distinct()



#: The current files; only the languages of the test tables are named.
FILES = """
files AS (
  SELECT path, content, CASE lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript'
         WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'json' THEN 'json' ELSE 'unknown' END AS language
  FROM (SELECT path, arg_max(content, ts) FILTER (WHERE content IS NOT NULL) AS content,
               arg_max(event_type, ts) FILTER (WHERE event_type IN ('add', 'change', 'unlink')) AS last_event
        FROM file_changes GROUP BY path)
  WHERE content IS NOT NULL AND last_event <> 'unlink')
"""
SYMBOLS = """
syms AS (SELECT * EXCLUDE (rn, file_path), file_path AS path FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY symbol_id) AS rn FROM symbols) WHERE rn = 1)
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pattern(text: str) -> str:
    """A rule's pattern as a SQL literal for RE2: dot and anchors as in the rule."""
    return quoted(text)


def count_matches(column: str, rule: str) -> str:
    return f"len(regexp_extract_all({column}, {pattern(rule)}))"


def rule_values(rows: list[tuple], names: str) -> str:
    """Rows as a VALUES relation."""
    def cell(v: object) -> str:
        return "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v)

    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


SEARCH_RULE_VALUES = rule_values([(i, n, lang, p) for i, (n, lang, p, _) in enumerate(rules.SEARCH_RULES)], "place, rule, lang, pattern")
