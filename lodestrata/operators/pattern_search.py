"""Pattern search: regular expressions and built-in rules over files (F2)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import rules

#: Guards of custom expressions.
MAX_PATTERN = 1000
_NESTED = re.compile(r"[+*]\)?[+*{]")


def catalogue(spark: SparkSession, language: str | None = None) -> DataFrame:
    """The built-in rules; a language keeps its own and the generic ones."""
    kept = [(n, lang, p, d) for n, lang, p, d in rules.SEARCH_RULES if language is None or lang in (None, language)]
    return spark.createDataFrame(kept, "name string, language string, pattern string, description string")


def is_allowed(pattern: str) -> bool:
    """Whether a custom expression compiles, is short and has no nested quantifiers."""
    if not pattern or len(pattern) > MAX_PATTERN or _NESTED.search(pattern):
        return False
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def matching_rules(query: str) -> list[tuple[str, str | None, str, str]]:
    """Built-in rules whose name contains the query."""
    return [r for r in rules.SEARCH_RULES if query.lower() in r[0].lower()]


def score(n_matches: Column, n_rules: Column) -> Column:
    return 0.6 * F.least(n_matches / 10.0, F.lit(1.0)) + 0.4 * F.least(n_rules / 5.0, F.lit(1.0))


def _count(content: Column, pattern: str) -> Column:
    return F.regexp_count(content, F.lit(rules.java(pattern)))


def search(files: DataFrame, query: str, key: str = "path", limit: int = 50) -> DataFrame:
    """(key, n_matches, n_rules, score): files that fit the built-in rules the query names; where none of them
    matches, the query itself is taken as an expression without regard to case.

    files: (key, language, content). Each rule is a literal of its own in one projection, so that it is compiled once.
    """
    content, language = F.col("content"), F.col("language")
    counts = [F.when(F.lit(True) if lang is None else language == lang, _count(content, p)).otherwise(0) for _, lang, p, _ in matching_rules(query)]
    # The counts are a column of their own, so that each rule runs once though two sums use it.
    ruled = files.select(key, "content", F.array(*counts, F.lit(0)).alias("hits"))
    add = lambda values: F.aggregate(values, F.lit(0), lambda a, v: a + v)
    counted = ruled.select(key, "content", add(F.col("hits")).alias("ruled"), F.size(F.filter("hits", lambda v: v > 0)).alias("hit_rules"))
    custom = _count(content, "(?im)" + query) if is_allowed(query) else F.lit(0)
    return (
        counted.select(key, "ruled", "hit_rules", F.when((F.coalesce("ruled", F.lit(0)) == 0) & F.col("content").isNotNull(), custom).otherwise(0).alias("own"))
        .select(key, (F.col("ruled") + F.col("own")).cast("long").alias("n_matches"), F.when(F.col("own") > 0, 1).otherwise(F.col("hit_rules")).cast("long").alias("n_rules"))
        .where("n_matches > 0")
        .withColumn("score", F.round(score(F.col("n_matches"), F.col("n_rules")), 6))
        .orderBy(F.col("score").desc(), F.col("n_matches").desc(), key)
        .limit(limit)
    )


def rule_counts(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, rule, n_matches) of all built-in rules over files (key, language, content)."""
    content, language = F.col("content"), F.col("language")
    entries = [F.struct(F.lit(n).alias("rule"), F.when(F.lit(True) if lang is None else language == lang, _count(content, p)).otherwise(0).cast("long").alias("n_matches")) for n, lang, p, _ in rules.SEARCH_RULES]
    return files.select(key, F.inline(F.filter(F.array(*entries), lambda e: e["n_matches"] > 0)))


def spans(files: DataFrame, patterns: list[tuple[str, str | None, str]], key: str = "path", context: int = 2) -> DataFrame:
    """One row per match with its place: (key, rule, line_start, line_end, column_start, column_end, text, before, after, groups).

    Lines and columns are 1-based; groups holds named groups, else numbered ones that are not empty. Offsets need the
    matcher itself, so the texts pass through Python in Arrow batches.
    """
    schema = "`" + key + "` string, rule string, line_start int, line_end int, column_start int, column_end int, text string, before string, after string, groups map<string,string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(name, lang, re.compile(p)) for name, lang, p in patterns]
        kinds = [pa.string(), pa.string(), *[pa.int32()] * 4, *[pa.string()] * 3, pa.map_(pa.string(), pa.string())]
        names = [key, "rule", "line_start", "line_end", "column_start", "column_end", "text", "before", "after", "groups"]
        for batch in batches:
            rows = []
            for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines: list[str] | None = None
                for name, lang, expression in compiled:
                    if text is None or lang not in (None, language):
                        continue
                    for m in expression.finditer(text):
                        lines = text.split("\n") if lines is None else lines
                        first, last = text.count("\n", 0, m.start()) + 1, text.count("\n", 0, m.end()) + 1
                        groups = {k: v for k, v in m.groupdict().items() if v} or {str(i): g for i, g in enumerate(m.groups(), 1) if g}
                        rows.append(
                            (path, name, first, last, m.start() - text.rfind("\n", 0, m.start()), m.end() - text.rfind("\n", 0, m.end()), m.group(),
                             "\n".join(lines[max(0, first - 1 - context) : first - 1]), "\n".join(lines[last : last + context]), list(groups.items()))
                        )
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return files.select(F.col(key).cast("string"), "language", "content").mapInArrow(run, schema)
