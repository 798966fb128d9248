"""Typed entity tables (F8): schemas, upsert, update, delete, lookups and counts as pure frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.security import escape_like

#: The entity tables' columns; JSON columns are strings in the store and decoded on reading.
SCHEMAS = {
    "semantic_concepts": "id string, name string, concept_type string, file_path string, description string, signature string, relationships string, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz, confidence double, line_start int, line_end int",
    "developer_patterns": "id string, pattern_type string, name string, frequency int, examples string, file_paths string, confidence double, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "architectural_decisions": "id string, title string, context string, decision string, consequences string, status string, related_files string, tags string, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "file_intelligence": "id string, file_path string, language string, summary string, concepts string, imports string, exports string, dependencies string, dependents string, complexity_score double, metrics string, metadata string, last_analyzed timestamp_ntz, content_hash string",
    "shared_patterns": "id string, name string, description string, pattern_code string, occurrences string, frequency int, category string, confidence double, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "ai_insights": "id string, insight_type string, title string, description string, affected_files string, severity string, confidence double, suggested_action string, code_snippet string, metadata string, created_at timestamp_ntz, acknowledged boolean, resolved boolean",
    "project_metadata": "id string, name string, path string, tech_stack string, build_tools string, vcs_type string, default_branch string, file_count int, total_lines int, languages string, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz, last_analyzed timestamp_ntz",
    "feature_maps": "id string, feature_name string, description string, files string, entry_points string, keywords string, metadata string, confidence double, created_at timestamp_ntz, updated_at timestamp_ntz",
    "entry_points": "id string, name string, file_path string, entry_type string, description string, exports string, metadata string, created_at timestamp_ntz",
    "key_directories": "id string, path string, name string, purpose string, file_count int, languages string, patterns string, metadata string, created_at timestamp_ntz",
    "work_sessions": "id string, name string, feature string, files string, tasks string, notes string, metadata string, started_at timestamp_ntz, updated_at timestamp_ntz, ended_at timestamp_ntz",
    "project_decisions": "id string, decision string, context string, rationale string, session_id string, related_files string, tags string, metadata string, created_at timestamp_ntz",
}
#: Columns besides the id that are unique; a new row evicts the one that holds its value.
UNIQUE = {"file_intelligence": "file_path", "key_directories": "path"}


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``. Whole rows are compared by an aggregate with a map-side part, so a hot key
    ships one row per task."""
    value = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.max_by(value, F.struct(*order)).alias("_row")).select("_row.*")


def upsert(table: DataFrame, changes: DataFrame, key: str = "id", sequence: str = "seq", unique: str | None = None) -> DataFrame:
    """The table after the changes (its columns and ``sequence``): of a key the change with the greatest sequence replaces the row.

    unique: a further column without repeats; the row that held a change's value goes. Keys that are null never match.
    """
    newest = latest_per_key(changes, [key], [F.col(sequence)])
    if unique:
        newest = latest_per_key(newest, [unique], [F.col(sequence)])
    kept = table.join(newest.select(key), key, "left_anti")
    if unique:
        kept = kept.join(newest.select(unique), unique, "left_anti")
    return kept.select(*table.columns).unionByName(newest.select(*table.columns))


def set_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """UPDATE … SET … WHERE as a projection."""
    return table.withColumns({name: F.when(condition, value).otherwise(F.col(name)) for name, value in values.items()})


def delete_keys(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def like_search(table: DataFrame, text: str, columns: list[str], order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of which a column holds the text, whatever its case; wildcards in the text are ordinary signs."""
    pattern = f"%{escape_like(text)}%"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    found = table.where(hit)
    if order:
        found = found.orderBy(*order)
    return found.limit(limit) if limit is not None else found


def json_strings(column: str) -> Column:
    """A JSON list of strings; the empty list where it is null or cannot be read."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def json_map(column: str) -> Column:
    return F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>"))


def cleared(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every table without its rows, with its columns."""
    return {name: frame.limit(0) for name, frame in tables.items()}


def drop_collection(spark: SparkSession, folder: str, name: str) -> bool:
    """Delete a written table with all its versions; whether there was one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(system.exists(path) and system.delete(path, True))


def compact(spark: SparkSession, source: str, target: str, rows_per_file: int = 1_000_000) -> None:
    """Rewrite a table into few files of bounded size; the old files stay until the caller drops them."""
    spark.read.parquet(source).write.option("maxRecordsPerFile", rows_per_file).mode("errorifexists").parquet(target)


def backup(spark: SparkSession, source: str, target: str) -> int:
    """Copy a table before it is migrated; the number of rows. A backup is written once."""
    frame = spark.read.parquet(source)
    frame.write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target).count()


def rollback(applied: DataFrame, defined: DataFrame, target: int = 0) -> DataFrame:
    """(version, statement, place): the reversals, latest first, that lead from the applied migrations down to a version.

    applied: (version). defined: (version, down). Applied versions without a definition or a reversal come out with a null
    statement, for the caller to stop at.
    """
    due = applied.where(F.col("version") > target).select("version").distinct().join(defined.select("version", F.col("down").alias("statement")), "version", "left")
    return due.withColumn("place", F.row_number().over(Window.orderBy(F.col("version").desc())))


def pattern_to_detected(patterns: DataFrame) -> DataFrame:
    """(id, pattern_type, name, confidence, frequency, file_path, snippet): a stored pattern as it was detected, with its first path and example."""
    first = lambda column: F.try_element_at(json_strings(column), F.lit(1))
    return patterns.select("id", "pattern_type", "name", "confidence", "frequency", first("file_paths").alias("file_path"), first("examples").alias("snippet"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    parts = [frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, frame in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def migration_state(applied: DataFrame, defined: DataFrame) -> DataFrame:
    """(version, state): applied migrations against the defined ones: ok, checksum mismatch or unknown."""
    known = defined.select("version", F.col("checksum").alias("expected"))
    return applied.join(known, "version", "left").select("version", F.when(F.col("expected").isNull(), "unknown").when(F.col("expected") != F.col("checksum"), "mismatch").otherwise("ok").alias("state"))


#: Storage types of symbol kinds; other kinds keep their name.
STORAGE_KINDS = {
    "trait": "interface", "struct": "class", "constructor": "method", "field": "variable", "namespace": "module", "lambda": "function", "type_alias": "type",
}


def storage_kind(kind: Column) -> Column:
    mapped = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, target in STORAGE_KINDS.items():
        mapped = mapped.when(kind == name, target)
    return mapped.otherwise(kind)


def symbols_to_concepts(symbols: DataFrame) -> DataFrame:
    """Concept rows of symbols (path, name, kind, docstring, signature, start_line, end_line, confidence) with deterministic ids."""
    kind = storage_kind(F.col("kind"))
    return symbols.select(
        F.substring(F.sha2(F.concat_ws(":", "name", kind, "path"), 256), 1, 16).alias("id"), "name", kind.alias("concept_type"), F.col("path").alias("file_path"),
        F.coalesce(F.nullif("docstring", F.lit("")), F.nullif("signature", F.lit("")), F.lit("")).alias("description"),
        F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), "confidence",
    )
