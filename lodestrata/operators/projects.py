"""Whole projects: their key symbols, what is known of them, their overview as text, registered backends and projects."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds that are shown of a file.
TOP_KINDS = ("class", "function", "interface")
FILES_SHOWN, SYMBOLS_SHOWN = 10, 20


def key_symbols(candidates: DataFrame, symbols: DataFrame, max_files: int = FILES_SHOWN, max_symbols: int = SYMBOLS_SHOWN) -> DataFrame:
    """(repo, path, name, kind, place): the first top-level symbols of the first candidate files of each repository.

    candidates: (repo, path, order); a path counts once, by its least order, ties by path. symbols: (path, symbol_id, name, kind,
    start_line, parent); top-level ones have no parent. The limits are what the report shows.
    """
    once = candidates.groupBy("repo", "path").agg(F.min("order").alias("order"))
    files = once.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("order", "path"))).where(F.col("n") <= max_files)
    shown = symbols.where(F.col("kind").isin(*TOP_KINDS) & (F.trim(F.coalesce("parent", F.lit(""))) == "")).select("path", "symbol_id", "name", "kind", "start_line")
    place = F.row_number().over(Window.partitionBy("path").orderBy("start_line", "symbol_id"))
    return shown.join(files.select("repo", "path"), "path").withColumn("place", place).where(F.col("place") <= max_symbols).select("repo", "path", "name", "kind", "place")


def has_intelligence(repositories: DataFrame, concepts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(repo, n_concepts, n_patterns, learned) of repositories (repo) over rows (repo) of both kinds."""
    count = lambda frame, name: frame.groupBy("repo").agg(F.count(F.lit(1)).alias(name))
    joined = repositories.select("repo").distinct().join(count(concepts, "n_concepts"), "repo", "left").join(count(patterns, "n_patterns"), "repo", "left").na.fill(0, ["n_concepts", "n_patterns"])
    return joined.withColumn("learned", F.col("n_concepts") + F.col("n_patterns") > 0)


def _section(title: str, lines: Column) -> Column:
    """A heading with its lines and an empty line; nothing if there are no lines."""
    return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(f"## {title}")), lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))


def overview_text(blueprints: DataFrame) -> DataFrame:
    """(repo, text): the blueprint of a repository as a text to remember; columns as ``services.blueprint`` gives them."""
    items = lambda column: F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda x: x != "")
    bullets = lambda column: F.transform(items(column), lambda x: F.concat(F.lit("- "), x))
    directories = F.transform(items("directories"), lambda x: F.concat(F.lit("- `"), F.substring_index(x, ":", -1), F.lit("/` — "), F.substring_index(x, ":", 1)))
    head = F.array(F.lit("# Project Overview"), F.lit(""), F.lit("Auto-generated from codebase analysis."), F.lit(""))
    stack = F.concat(bullets("languages"), bullets("frameworks"))
    style = F.when(F.coalesce("style", F.lit("")) != "", F.array("style")).otherwise(F.array().cast("array<string>"))
    return blueprints.select("repo", F.array_join(F.concat(head, _section("Tech Stack", stack), _section("Architecture", style), _section("Key Directories", directories)), "\n").alias("text"))


def analyse_projects(measured: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, n_files, n_languages, cyclomatic, maintainability, n_edges, n_external): complexity and dependencies of each repository.

    measured: (repo, cyclomatic, maintainability). edges: (repo, is_external). files: (repo, language).
    """
    shape = files.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("language").alias("n_languages"))
    # Sums of decimals do not depend on the order of the rows.
    mean = lambda c: (F.sum(F.col(c).cast("decimal(18,4)")).cast("double") / F.count(c)).alias(c)
    complexity = measured.groupBy("repo").agg(mean("cyclomatic"), mean("maintainability"))
    depends = edges.groupBy("repo").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if("is_external").alias("n_external"))
    return shape.join(complexity, "repo", "left").join(depends, "repo", "left").na.fill(0, ["n_edges", "n_external"])


class Backends:
    """Extractors by name and priority; the result of each is a frame, and all results together carry their priority."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[int, Callable[[DataFrame], DataFrame]]] = {}

    def register(self, name: str, priority: int, extract: Callable[[DataFrame], DataFrame]) -> None:
        """A backend of a name that is known replaces it."""
        self._known[name] = (priority, extract)

    def names(self) -> list[str]:
        """The greatest priority first, ties by name."""
        return sorted(self._known, key=lambda n: (-self._known[n][0], n))

    def extract(self, files: DataFrame) -> DataFrame:
        """The rows of all backends with the columns backend and priority."""
        out = None
        for name in self.names():
            priority, run = self._known[name]
            part = run(files).withColumns({"backend": F.lit(name), "priority": F.lit(priority)})
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no backend is registered")
        return out


def available_searches(vectors: DataFrame | None, embed: Callable | None) -> list[str]:
    """Search types that can be used: text and pattern always, semantic with vectors and an embedder."""
    return ["text", "pattern", *(["semantic"] if vectors is not None and embed is not None else [])]


def write_registry(projects: DataFrame, folder: str) -> None:
    """Projects (path, activated_at) as JSON lines, replaced as a whole when the write is committed."""
    projects.select("path", "activated_at").coalesce(1).write.mode("overwrite").json(folder)


def request_ids(rows: DataFrame, column: str = "request_id") -> DataFrame:
    """Rows with a random id each."""
    return rows.withColumn(column, F.uuid())


def embedded(rows: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], column: str = "embedding", batch: int = 32) -> DataFrame:
    """Rows with the unit vector of a text, by an embedder of lists of texts that is called for ``batch`` texts at a time.

    Null texts have a null vector, and so has a text whose vector is zero. Other columns stay.
    """
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out: list[list[float] | None] = []
        for at in range(0, len(texts), batch):
            some = texts.iloc[at : at + batch]
            kept = [t for t in some if t is not None]
            found = iter(np.asarray(embed(kept), np.float64)) if kept else iter(())
            for t in some:
                vector = next(found) if t is not None else None
                length = 0.0 if vector is None else float(np.linalg.norm(vector))
                out.append((vector / length).astype(np.float32).tolist() if length > 0 else None)
        return pd.Series(out, index=texts.index)

    return rows.withColumn(column, run(F.col(text)))


def hashed_words(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Vectors of word and part-of-word counts by hashing, which need no model: of each word its letters' trigrams and itself."""
    import re
    import zlib

    out = []
    for text in texts:
        vector = [0.0] * dim
        for word in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+", text):
            word = word.lower()
            for part in (word, *(f"<{word}>"[k : k + 3] for k in range(len(word)))):
                h = zlib.crc32(part.encode())
                vector[h % dim] += 1.0 if h & 0x10000 else -1.0
        out.append(vector)
    return out


def repositories(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(repo) of paths (path), each once."""
    from lodestrata.sources.tables import path_repository

    return paths.select(path_repository(F.col("path")).alias("repo")).distinct()
