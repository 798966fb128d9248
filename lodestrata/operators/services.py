"""Compositions of operators into the services that callers use: search, learning, blueprint, status, investigation, insights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.naming import naming_style
from lodestrata.functions.security import clamp
from lodestrata.operators import extraction, files, metrics, pattern_search, store, text_search, vector_search
from lodestrata.sources.tables import path_repository

MAX_RESULTS = 500


def search_codebase(
    sources: DataFrame, query: str, search_type: str = "text", limit: int = 50, language: str | None = None, vectors: DataFrame | None = None, embed: Callable[[str], list[float]] | None = None
) -> DataFrame:
    """(key, score, search_type) over sources (path, language, content).

    pattern and semantic search are used where they can be; an unknown type, or semantic search without vectors or
    an embedder, falls back to text search with the same limit and language.
    """
    limit = clamp(limit, 1, MAX_RESULTS)
    kept = sources if language is None else sources.where(F.col("language") == language)
    if search_type == "semantic" and vectors is not None and embed is not None:
        found = vector_search.search(vectors, embed(query), limit=limit, filters={"language": language})
        return found.select(F.col("id").alias("key"), "score", F.lit("semantic").alias("search_type"))
    if search_type == "pattern":
        return pattern_search.search(kept, query, limit=limit).select(F.col("path").alias("key"), "score", F.lit("pattern").alias("search_type"))
    return text_search.search(kept, query, limit=limit).select(F.col("path").alias("key"), "score", F.lit("text").alias("search_type"))


def learn(sources: DataFrame) -> dict[str, DataFrame]:
    """The concept and pattern rows of source files, with ids made from their content, so that learning again replaces them."""
    found = extraction.concepts(sources)
    concepts = found.select(
        F.substring(F.sha2(F.concat_ws(":", "name", "concept_type", "path"), 256), 1, 16).alias("id"), "name", "concept_type", F.col("path").alias("file_path"), "confidence", F.col("n").alias("occurrences")
    )
    patterns = extraction.detected_patterns(sources).select(
        F.substring(F.sha2(F.concat_ws(":", "pattern_type", "path"), 256), 1, 16).alias("id"), "pattern_type", F.col("path").alias("file_path"), "confidence", "frequency"
    )
    return {"concepts": concepts, "patterns": patterns}


def persist(spark: SparkSession, learnt: dict[str, DataFrame], folder: str, version: int) -> None:
    """Write each table's new version: the rows of the version before, updated by the learnt ones. A version is written once."""
    for name, rows in learnt.items():
        if version:
            rows = store.upsert(spark.read.parquet(f"{folder}/{name}/{version - 1}"), rows.withColumn("seq", F.lit(version)))
        rows.write.mode("errorifexists").parquet(f"{folder}/{name}/{version}")


def blueprint(sources: DataFrame) -> DataFrame:
    """One row per repository: languages, frameworks, key directories by type, entry points, style and number of files."""
    repo = path_repository(F.col("path")).alias("repo")
    joined = lambda column: F.array_join(F.array_sort(F.collect_set(column)), ",")
    base = sources.groupBy(repo).agg(F.count(F.lit(1)).alias("n_files"), joined("language").alias("languages"))
    dirs = files.key_directories(sources)
    typed = dirs.where("directory_type <> 'other'").groupBy("repo").agg(joined(F.concat_ws(":", "directory_type", "directory")).alias("directories"))
    entries = files.entry_points(sources).select(repo, "entry_type")
    counted = entries.groupBy("repo").agg(F.count(F.lit(1)).alias("n_entry_points"))
    used = frameworks_by_repo(sources)
    style = files.architecture_style(dirs.select("repo", "directory_type"), entries, used.select("repo"))
    named = used.groupBy("repo").agg(joined("framework").alias("frameworks"))
    out = base.join(named, "repo", "left").join(typed, "repo", "left").join(counted, "repo", "left").join(style, "repo", "left")
    return out.select(
        "repo", "n_files", "languages", F.coalesce("frameworks", F.lit("")).alias("frameworks"), F.coalesce("directories", F.lit("")).alias("directories"),
        F.coalesce("n_entry_points", F.lit(0)).alias("n_entry_points"), F.coalesce("style", F.lit("")).alias("style"),
    )


def frameworks_by_repo(sources: DataFrame) -> DataFrame:
    """(repo, framework), each once."""
    from lodestrata.operators import rules

    hits = F.array_compact(F.array(*[F.when((F.col("language") == lang) & F.col("content").rlike(rules.java(pattern)), F.lit(name)) for lang, name, pattern in rules.FRAMEWORK_RULES]))
    return sources.select(path_repository(F.col("path")).alias("repo"), F.explode(hits).alias("framework")).distinct()


def system_status(tables: dict[str, DataFrame], breakdown: dict[str, str]) -> DataFrame:
    """(section, item, n, confidence): rows of each table, and for those in ``breakdown`` rows and mean confidence by a column."""
    out = store.counts(tables).select(F.lit("tables").alias("section"), F.col("table_name").alias("item"), "n", F.lit(None).cast("double").alias("confidence"))
    for name, column in breakdown.items():
        part = tables[name].groupBy(F.col(column).alias("item")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))
        out = out.unionByName(part.select(F.lit(name).alias("section"), "item", "n", "confidence"))
    return out


def investigate(symbols: DataFrame, contents: DataFrame, language: str = "python") -> DataFrame:
    """(symbol_id, name, style, cyclomatic, cognitive, maintainability, levels) of symbols (symbol_id, path, name, start_line, end_line)."""
    texts = metrics.symbol_texts(symbols.select("symbol_id", "path", "name", "start_line", "end_line"), contents).select("symbol_id", "name", "content")
    measured = metrics.analyse(texts, language)
    return measured.select("symbol_id", "name", naming_style(F.col("name")).alias("style"), "cyclomatic", "cyclomatic_level", "cognitive", "cognitive_level", "maintainability")


def contributed_insights(contributions: DataFrame) -> DataFrame:
    """Insight rows of contributions (id, insight_type, content as JSON, confidence, acknowledged, resolved).

    title: the content's title, practice or the type; description: its description, reasoning or the content; action: its
    suggested action or fix. status: resolved before acknowledged before pending. Unreadable content counts as empty.
    """
    of = lambda key: F.get_json_object("content", f"$.{key}")
    return contributions.select(
        "id", "insight_type", F.coalesce(of("title"), of("practice"), "insight_type").alias("title"), F.coalesce(of("description"), of("reasoning"), "content").alias("description"),
        F.coalesce(of("suggested_action"), of("fix"), F.lit("")).alias("suggested_action"), "confidence",
        F.when(F.col("resolved"), "resolved").when(F.col("acknowledged"), "acknowledged").otherwise("pending").alias("status"),
    )


def unresolved(insights: DataFrame) -> DataFrame:
    return insights.where("status <> 'resolved'")


def read_registry(spark: SparkSession, path: str, existing: DataFrame) -> DataFrame:
    """(path, activated_at) of registered projects whose directory exists, the latest activated first; broken entries are left out."""
    rows = spark.read.schema("path string, activated_at timestamp_ntz, broken string").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows.where("path IS NOT NULL AND broken IS NULL").join(existing.select("path").distinct(), "path", "left_semi").select("path", "activated_at").orderBy(F.col("activated_at").desc_nulls_last(), "path")
