"""Queries: the entity store, sessions, decisions, memories and thoughts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import sessions, store
from lodestrata.plans.common import Query, distinct, quoted, symbols
from lodestrata.sources.tables import table

TABLES = ("semantic_concepts", "developer_patterns", "architectural_decisions", "project_decisions", "work_sessions")
CUT = "2025-01-01"


def _sessions(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest version of each session, only with the columns that are asked for."""
    wanted = list(dict.fromkeys(["id", "updated_at", "ended_at", *columns]))
    return sessions.current_sessions(table(spark, d, "work_sessions").select(*wanted))


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The concepts of the file with the least path, by its path."""
    c = distinct(spark, d, "semantic_concepts", "name", "concept_type", "file_path")
    least = table(spark, d, "semantic_concepts").agg(F.min("file_path").alias("file_path"))
    return c.join(F.broadcast(least), "file_path").select("id", "name", "concept_type", "file_path")


def concepts_by_type(spark: SparkSession, d: str) -> DataFrame:
    return distinct(spark, d, "semantic_concepts", "concept_type", "name", "file_path").where("concept_type = 'class'").select("id", "name", "file_path")


def like_search(spark: SparkSession, d: str) -> DataFrame:
    return store.like_search(distinct(spark, d, "semantic_concepts", "name", "description"), "cache", ["name", "description"], ["name", "id"], 100).select("id", "name")


def like_search_escaped(spark: SparkSession, d: str) -> DataFrame:
    """An underscore is searched as itself."""
    return store.like_search(distinct(spark, d, "developer_patterns", "pattern_type", "file_paths"), "y_i", ["pattern_type", "file_paths"]).select("id", "pattern_type")


def feature_search(spark: SparkSession, d: str) -> DataFrame:
    """Features (directories) whose name or list of files, as text, holds a word."""
    s = _sessions(spark, d, "feature", "name", "files")
    return store.like_search(s, "rout", ["feature", "name", "files"]).select("id", "feature")


def active_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.active(_sessions(spark, d, "name", "started_at")).select("id", "name", "started_at")


def latest_active_session(spark: SparkSession, d: str) -> DataFrame:
    return sessions.active(_sessions(spark, d, "started_at")).agg(F.max_by("id", F.struct("started_at", "id")).alias("id"))


def top_patterns(spark: SparkSession, d: str) -> DataFrame:
    return distinct(spark, d, "developer_patterns", "pattern_type", "frequency").orderBy(F.col("frequency").desc(), "id").limit(10)


def recent_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(spark, d)
    counted = sessions.with_decision_counts(s, table(spark, d, "project_decisions"))
    return counted.select("id", "updated_at", "n_decisions").orderBy(F.col("updated_at").desc(), "id").limit(10)


def session_decision_counts(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(spark, d)
    return sessions.with_decision_counts(s, table(spark, d, "project_decisions")).select("id", "n_decisions")


def recent_decisions(spark: SparkSession, d: str) -> DataFrame:
    return distinct(spark, d, "project_decisions", "created_at").orderBy(F.col("created_at").desc(), "id").limit(20)


def decisions_by_session(spark: SparkSession, d: str) -> DataFrame:
    return distinct(spark, d, "project_decisions", "session_id", "created_at").where("session_id <> ''").select(F.lower(F.trim("session_id")).alias("session_id"), "id", "created_at").distinct()


def store_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.counts({name: table(spark, d, name) for name in TABLES})


def upsert_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Rows updated before a day are the table, later ones the changes: the newest row of an id stays."""
    rows = distinct(spark, d, "semantic_concepts", "name", "updated_at")
    old, new = rows.where(F.col("updated_at") < CUT), rows.where(F.col("updated_at") >= CUT).withColumn("seq", F.struct("updated_at", "name"))
    return store.upsert(old, new)


def upsert_unique_path(spark: SparkSession, d: str) -> DataFrame:
    """File records are unique by path too: a change evicts the row that held its path."""
    rows = symbols(spark, d).groupBy(F.col("symbol_id").cast("string").alias("id"), F.col("path").alias("file_path")).agg(F.max("start_line").alias("line"))
    old = rows.where("line < 10")
    new = rows.where("line >= 10").withColumn("seq", F.struct("line", "id"))
    return store.upsert(old, new, unique="file_path").select("id", "file_path")


def update_flags(spark: SparkSession, d: str) -> DataFrame:
    a = distinct(spark, d, "architectural_decisions", "status", "title")
    return store.set_where(a, F.lower("status") == "accepted", status=F.lit("acknowledged")).select("id", F.lower("status").alias("status"), "title").distinct()


def end_session(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(spark, d)
    least = s.where("ended_at IS NULL").agg(F.min("id").alias("target"))
    joined = s.crossJoin(least)
    return joined.select("id", F.when(F.col("id") == F.col("target"), F.lit(CUT).cast("timestamp_ntz")).otherwise(F.col("ended_at")).alias("ended_at"))


def delete_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Concepts without those of files whose last event is an unlink."""
    c = distinct(spark, d, "semantic_concepts", "file_path")
    last = table(spark, d, "file_changes").where("event_type IN ('add', 'change', 'unlink')").groupBy(F.col("path").alias("file_path")).agg(F.max_by("event_type", F.struct("ts", "change_id")).alias("last"))
    return store.delete_keys(c, last.where("last = 'unlink'"), "file_path").select("id", "file_path")


def delete_by_id(spark: SparkSession, d: str) -> DataFrame:
    p = distinct(spark, d, "developer_patterns", "confidence", "name")
    return store.delete_keys(p, p.where("confidence IS NULL")).select("id", "name")


def json_defaults(spark: SparkSession, d: str) -> DataFrame:
    p = distinct(spark, d, "developer_patterns", "file_paths")
    return p.select("id", F.size(store.json_strings("file_paths")).alias("n_paths"), F.array_join(F.array_sort(F.array_distinct(F.transform(store.json_strings("file_paths"), lambda x: F.trim(x)))), "|").alias("paths"))


def session_patch(spark: SparkSession, d: str) -> DataFrame:
    """Notes are set where the change has some, the name stays."""
    s = _sessions(spark, d, "name", "notes").select("id", "name", "notes")
    change = s.where("notes IS NULL").select("id", F.concat(F.lit("notes of "), "id").alias("notes"))
    return sessions.patch(s, change)


def session_add_file(spark: SparkSession, d: str) -> DataFrame:
    s = _sessions(spark, d, "files", "feature")
    added = sessions.append_if_absent(store.json_strings("files"), F.concat("feature", F.lit("/new.py")))
    return s.select("id", F.size(added).alias("n_files"), F.array_join(added, "|").alias("files"))


def memory_search(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select(F.concat_ws("-", "doc_type", "doc_id").alias("name"), F.col("text").alias("content"))
    return sessions.search_memories(m, "memory", 20)


def memory_edit(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").where("text IS NOT NULL")
    return m.select("doc_id", sessions.edit_memory(F.col("text"), "cache", "CACHE").alias("edited")).where("edited IS NOT NULL").select("doc_id", F.sha2("edited", 256).alias("edited_hash"))


def memory_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_type = 'memory'").select("doc_id", "n_chars", "created_at", sessions.valid_memory_name(F.concat_ws("-", "source", "doc_id")).alias("valid_name"))


def thought_chains(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of a session as its thoughts: the branch is the month, a rationale revises the thought before."""
    p = distinct(spark, d, "project_decisions", "session_id", "created_at", "context", "rationale").where("session_id <> ''")
    number = F.dayofmonth("created_at")
    return sessions.chain_summary(p.select(
        F.lower(F.trim("session_id")).alias("chain_id"), number.alias("thought_number"), F.lit(5).alias("total_thoughts"),
        F.when(F.col("context") != "", F.date_format("created_at", "yyyy-MM")).otherwise("").alias("branch_id"), F.when(F.col("rationale").isNotNull(), number - 1).alias("revises_thought"),
    ))


def migrations(spark: SparkSession, d: str) -> DataFrame:
    defined = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "version int, checksum string")
    applied = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "version int, checksum string")
    return store.migration_state(applied, defined)


def symbols_to_concepts(spark: SparkSession, d: str) -> DataFrame:
    return store.symbols_to_concepts(symbols(spark, d)).select("id", "name", "concept_type", "file_path", "description", "line_start", "line_end")


ERRORS = (
    (1, "TimeoutError", "timed out"), (2, "FileNotFoundError", "no such file /srv/data/x/y.txt"), (3, "ValueError", "bad value"), (4, "MemoryError", ""), (5, "OSError", "disk"),
    (6, "ApiError", "HTTP 429: too many requests"), (7, "ApiError", "502 bad gateway"), (8, "ApiError", "401 unauthorized"), (9, "ApiError", "weird"),
)


def error_classes(spark: SparkSession, d: str) -> DataFrame:
    e = spark.createDataFrame(list(ERRORS), "id int, kind string, message string")
    category, retry = sessions.classify_error(F.col("kind"), F.col("message"))
    return e.select("id", category.alias("category"), retry.alias("retryable"), sessions.hide_paths(F.col("message")).alias("message"))


def truncated_values(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.create_map(F.lit("text"), F.col("text")).alias("args"))
    return m.select("doc_id", F.length(sessions.truncate_values(F.col("args"))["text"]).alias("n"))


def queries() -> dict[str, Query]:
    return {
        "store_point_lookup": point_lookup, "store_by_type": concepts_by_type, "store_like_search": like_search, "store_like_escaped": like_search_escaped, "store_feature_search": feature_search,
        "store_active_sessions": active_sessions, "store_latest_active": latest_active_session, "store_top_patterns": top_patterns, "store_recent_sessions": recent_sessions,
        "store_session_decision_counts": session_decision_counts, "store_recent_decisions": recent_decisions, "store_decisions_by_session": decisions_by_session, "store_counts": store_counts,
        "store_upsert": upsert_concepts, "store_upsert_unique": upsert_unique_path, "store_update_flags": update_flags, "store_end_session": end_session, "store_delete_by_file": delete_by_file,
        "store_delete_by_id": delete_by_id, "store_json_defaults": json_defaults, "session_patch": session_patch, "session_add_file": session_add_file, "memory_search": memory_search,
        "memory_edit": memory_edit, "memory_list": memory_list, "thought_chains": thought_chains, "store_migrations": migrations, "store_symbols_to_concepts": symbols_to_concepts,
        "error_classes": error_classes, "truncated_values": truncated_values,
    }


_SESSIONS = "s AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, ended_at DESC NULLS LAST) AS rn FROM work_sessions) WHERE rn = 1)"
_COUNTS = "n AS (SELECT lower(trim(session_id)) AS id, count(DISTINCT id) AS n_decisions FROM project_decisions WHERE session_id <> '' GROUP BY 1)"
_PATHS = "CASE WHEN json_valid(file_paths) AND json_type(file_paths) = 'ARRAY' THEN CAST(file_paths AS VARCHAR[]) ELSE [] END"
_FILES = "CASE WHEN json_valid(files) AND json_type(files) = 'ARRAY' THEN CAST(files AS VARCHAR[]) ELSE [] END"


def oracle_sql() -> dict[str, str]:
    from lodestrata.plans.common import SYMBOLS

    kinds = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in store.STORAGE_KINDS.items())
    types = " ".join(f"WHEN kind IN ({', '.join(map(quoted, names.split()))}) THEN '{label}'" for names, label, _ in sessions.ERROR_TYPES)
    type_retry = " ".join(f"WHEN kind IN ({', '.join(map(quoted, names.split()))}) THEN {str(again).lower()}" for names, _, again in sessions.ERROR_TYPES)
    texts = " ".join(f"WHEN regexp_matches(lower(message), {quoted(p)}) THEN '{label}'" for p, label, _ in sessions.ERROR_MESSAGES)
    text_retry = " ".join(f"WHEN regexp_matches(lower(message), {quoted(p)}) THEN {str(again).lower()}" for p, _, again in sessions.ERROR_MESSAGES)
    return {
        "store_point_lookup": "SELECT DISTINCT id, name, concept_type, file_path FROM semantic_concepts WHERE file_path = (SELECT min(file_path) FROM semantic_concepts)",
        "store_by_type": "SELECT id, name, file_path FROM (SELECT DISTINCT * FROM semantic_concepts) WHERE concept_type = 'class'",
        "store_like_search": "SELECT id, name FROM (SELECT DISTINCT * FROM semantic_concepts) WHERE name ILIKE '%cache%' OR description ILIKE '%cache%' ORDER BY name, id LIMIT 100",
        "store_like_escaped": r"SELECT id, pattern_type FROM (SELECT DISTINCT * FROM developer_patterns) WHERE pattern_type ILIKE '%y\_i%' ESCAPE '\' OR coalesce(file_paths ILIKE '%y\_i%' ESCAPE '\', false)",
        "store_feature_search": f"WITH {_SESSIONS} SELECT id, feature FROM s WHERE feature ILIKE '%rout%' OR name ILIKE '%rout%' OR files ILIKE '%rout%'",
        "store_active_sessions": f"WITH {_SESSIONS} SELECT id, name, started_at FROM s WHERE ended_at IS NULL",
        "store_latest_active": f"WITH {_SESSIONS} SELECT (SELECT id FROM s WHERE ended_at IS NULL ORDER BY started_at DESC, id DESC LIMIT 1) AS id",
        "store_top_patterns": "SELECT id, pattern_type, frequency FROM (SELECT DISTINCT * FROM developer_patterns) ORDER BY frequency DESC, id LIMIT 10",
        "store_recent_sessions": f"WITH {_SESSIONS}, {_COUNTS} SELECT id, updated_at, coalesce(n_decisions, 0) AS n_decisions FROM s LEFT JOIN n USING (id) ORDER BY updated_at DESC, id LIMIT 10",
        "store_session_decision_counts": f"WITH {_SESSIONS}, {_COUNTS} SELECT id, coalesce(n_decisions, 0) AS n_decisions FROM s LEFT JOIN n USING (id)",
        "store_recent_decisions": "SELECT DISTINCT id, created_at FROM project_decisions ORDER BY created_at DESC, id LIMIT 20",
        "store_decisions_by_session": "SELECT DISTINCT lower(trim(session_id)) AS session_id, id, created_at FROM project_decisions WHERE session_id <> ''",
        "store_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES),
        "store_upsert": f"""WITH r AS (SELECT DISTINCT id, name, updated_at FROM semantic_concepts), new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, name DESC) AS rn FROM r WHERE updated_at >= '{CUT}') WHERE rn = 1)
            SELECT id, name, updated_at FROM r WHERE updated_at < '{CUT}' AND id NOT IN (SELECT id FROM new) UNION ALL SELECT id, name, updated_at FROM new""",
        "store_upsert_unique": """WITH r AS (SELECT CAST(symbol_id AS VARCHAR) AS id, file_path, max(start_line) AS line FROM symbols GROUP BY 1, 2),
            new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line DESC, id DESC) AS rn FROM r WHERE line >= 10) WHERE rn = 1)
            SELECT id, file_path FROM r WHERE line < 10 AND id NOT IN (SELECT id FROM new) AND file_path NOT IN (SELECT file_path FROM new) UNION ALL SELECT id, file_path FROM new""",
        "store_update_flags": "SELECT DISTINCT id, CASE WHEN lower(status) = 'accepted' THEN 'acknowledged' ELSE lower(status) END AS status, title FROM architectural_decisions",
        "store_end_session": f"WITH {_SESSIONS} SELECT id, CASE WHEN id = (SELECT min(id) FROM s WHERE ended_at IS NULL) THEN TIMESTAMP '{CUT}' ELSE ended_at END AS ended_at FROM s",
        "store_delete_by_file": "SELECT id, file_path FROM (SELECT DISTINCT * FROM semantic_concepts) WHERE file_path NOT IN (SELECT path FROM file_changes WHERE event_type IN ('add', 'change', 'unlink') GROUP BY path HAVING arg_max(event_type, ts) = 'unlink')",
        "store_delete_by_id": "WITH p AS (SELECT DISTINCT * FROM developer_patterns) SELECT id, name FROM p WHERE id NOT IN (SELECT id FROM p WHERE confidence IS NULL)",
        "store_json_defaults": f"WITH p AS (SELECT DISTINCT * FROM developer_patterns) SELECT id, len({_PATHS})::INT AS n_paths, array_to_string(list_sort(list_distinct(list_transform({_PATHS}, lambda x: trim(x)))), '|') AS paths FROM p",
        "session_patch": f"WITH {_SESSIONS} SELECT id, name, coalesce(notes, 'notes of ' || id) AS notes FROM s",
        "session_add_file": f"WITH {_SESSIONS}, a AS (SELECT id, {_FILES} AS f, feature || '/new.py' AS x FROM s), b AS (SELECT id, CASE WHEN x IS NULL OR list_contains(f, x) THEN f ELSE list_append(f, x) END AS f FROM a) SELECT id, len(f)::INT AS n_files, array_to_string(f, '|') AS files FROM b",
        "memory_search": """SELECT name, score, snippet FROM (SELECT concat_ws('-', doc_type, doc_id) AS name, round((CASE WHEN contains(lower(concat_ws('-', doc_type, doc_id)), 'memory') THEN 0.8 ELSE 0 END) + (CASE WHEN contains(lower(text), 'memory') THEN 0.5 ELSE 0 END), 3)::DOUBLE AS score,
            substring(text, 1, 200) AS snippet FROM documents) WHERE score > 0 ORDER BY score DESC, name LIMIT 20""",
        "memory_edit": "SELECT doc_id, sha256(substring(text, 1, instr(text, 'cache') - 1) || 'CACHE' || substring(text, instr(text, 'cache') + 5)) AS edited_hash FROM documents WHERE instr(text, 'cache') > 0",
        "memory_list": "SELECT doc_id, n_chars, created_at, regexp_matches(concat_ws('-', source, doc_id), '^[A-Za-z0-9][A-Za-z0-9_.\\-]{0,199}$') AS valid_name FROM documents WHERE doc_type = 'memory'",
        "thought_chains": """WITH t AS (SELECT lower(trim(session_id)) AS chain_id, day(created_at) AS tn, CASE WHEN context <> '' THEN strftime(created_at, '%Y-%m') END AS b, CASE WHEN rationale IS NOT NULL THEN day(created_at) - 1 END AS r FROM (SELECT DISTINCT * FROM project_decisions) WHERE session_id <> '')
            SELECT chain_id, count(*) AS n_thoughts, greatest(5, max(tn))::INT AS total_thoughts, coalesce(array_to_string(list_sort(list_distinct(list(b) FILTER (WHERE b IS NOT NULL))), ','), '') AS branches,
                   coalesce(array_to_string(list_sort(list_distinct(list(r) FILTER (WHERE r IS NOT NULL))), ','), '') AS revisions FROM t GROUP BY 1""",
        "store_migrations": "SELECT * FROM (VALUES (1, 'ok'), (2, 'mismatch'), (4, 'unknown')) AS v(version, state)",
        "store_symbols_to_concepts": f"""WITH {SYMBOLS}, k AS (SELECT *, CASE kind {kinds} ELSE kind END AS concept_type FROM syms)
            SELECT substring(sha256(concat_ws(':', name, concept_type, path)), 1, 16) AS id, name, concept_type, path AS file_path, coalesce(nullif(docstring, ''), nullif(signature, ''), '') AS description, start_line AS line_start, end_line AS line_end FROM k""",
        "error_classes": f"""WITH e(id, kind, message) AS (VALUES {', '.join(f"({i}, {quoted(k)}, {quoted(m)})" for i, k, m in ERRORS)})
            SELECT id, CASE {types} {texts} ELSE 'unknown' END AS category, CASE {type_retry} {text_retry} ELSE false END AS retryable, CASE id WHEN 2 THEN 'no such file y.txt' ELSE message END AS message FROM e""",
        "truncated_values": "SELECT doc_id, CASE WHEN length(text) > 200 THEN 203 ELSE length(text) END::INT AS n FROM documents WHERE text IS NOT NULL",
    }
