"""Work sessions, decisions, memories and chains of thought (F8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.store import latest_per_key

MAX_MEMORY = 1_000_000
#: Valid names of memories, after a closing .md is dropped.
MEMORY_NAME = r"^[A-Za-z0-9][A-Za-z0-9_.\-]{0,199}$"


def current_sessions(sessions: DataFrame) -> DataFrame:
    """The latest version of each session."""
    return latest_per_key(sessions, ["id"], [F.col("updated_at"), F.col("ended_at")])


def active(sessions: DataFrame) -> DataFrame:
    return sessions.where("ended_at IS NULL")


def with_decision_counts(sessions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Sessions with ``n_decisions``, 0 where there are none. Decisions are counted before they are joined."""
    counted = decisions.where("session_id <> ''").groupBy(F.lower(F.trim("session_id")).alias("id")).agg(F.count_distinct(decisions["id"]).alias("n_decisions"))
    return sessions.join(counted, "id", "left").withColumn("n_decisions", F.coalesce("n_decisions", F.lit(0)))


def end(sessions: DataFrame, session_id: str, at: Column) -> DataFrame:
    return sessions.withColumn("ended_at", F.when(F.col("id") == session_id, at).otherwise(F.col("ended_at")))


def patch(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial update: the non-null columns of changes (id, …) replace those of the session; one change per id."""
    fields = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
    return sessions.join(new, "id", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in sessions.columns])


def append_if_absent(items: Column, item: Column) -> Column:
    """The list with the item at its end, unless it is there already."""
    base = F.coalesce(items, F.array().cast("array<string>"))
    return F.when(item.isNull() | F.array_contains(base, item), base).otherwise(F.array_append(base, item))


def valid_memory_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.md$", "").rlike(MEMORY_NAME) & ~name.contains("..")


def edit_memory(content: Column, old: str, new: str) -> Column:
    """The first occurrence replaced; null if there is none."""
    at = F.instr(content, old)
    return F.when(at > 0, F.concat(F.substring(content, F.lit(1), at - 1), F.lit(new), F.substring(content, at + len(old), F.length(content))))


def search_memories(memories: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """(name, score, snippet): 0.8 for the name and 0.5 for the content, whatever their case."""
    wanted = query.lower()
    in_name, in_text = F.lower("name").contains(wanted), F.lower("content").contains(wanted)
    score = F.when(in_name, 0.8).otherwise(0.0) + F.when(in_text, 0.5).otherwise(0.0)
    return memories.select("name", F.round(score, 3).alias("score"), F.substring("content", 1, 200).alias("snippet")).where("score > 0").orderBy(F.col("score").desc(), "name").limit(limit)


def chain_summary(thoughts: DataFrame) -> DataFrame:
    """Per chain: number of thoughts, the total grown to the largest number, sorted branches and revised thoughts.

    thoughts: (chain_id, thought_number, total_thoughts, branch_id, revises_thought); empty branches and null revisions do not count.
    """
    return thoughts.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("n_thoughts"),
        F.greatest(F.max("total_thoughts"), F.max("thought_number")).alias("total_thoughts"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("branch_id", F.lit("")))), ",").alias("branches"),
        F.array_join(F.transform(F.array_sort(F.collect_set("revises_thought")), lambda v: v.cast("string")), ",").alias("revisions"),
    )


def truncate_values(values: Column, longest: int = 200) -> Column:
    """Map values cut at a length, with a mark."""
    return F.transform_values(values, lambda k, v: F.when(F.length(v) > longest, F.concat(F.substring(v, 1, longest), F.lit("..."))).otherwise(v))


#: Error types, category and whether a retry may help; then patterns on the message.
ERROR_TYPES = (
    ("ConnectionError TimeoutError ConnectionResetError ConnectionRefusedError BrokenPipeError PermissionError", "transient", True),
    ("FileNotFoundError NotADirectoryError IsADirectoryError", "permanent", False),
    ("ValueError TypeError KeyError AttributeError", "client_error", False),
    ("MemoryError", "system_error", False),
    ("IOError OSError", "system_error", True),
)
ERROR_MESSAGES = (
    (r"rate.limit|too.many.requests|throttl|429|quota.exceeded", "transient", True),
    (r"service.unavailable|50[234]|bad.gateway|gateway.timeout", "transient", True),
    (r"unauthorized|authentication.failed|invalid.token|expired.token|40[13]", "permanent", False),
)


def classify_error(kind: Column, message: Column) -> tuple[Column, Column]:
    """(category, retryable) by type, else by message, else unknown."""
    category = F.when(F.lit(False), F.lit(None).cast("string"))
    retry = F.when(F.lit(False), F.lit(None).cast("boolean"))
    for names, label, again in ERROR_TYPES:
        hit = kind.isin(*names.split())
        category, retry = category.when(hit, label), retry.when(hit, F.lit(again))
    for pattern, label, again in ERROR_MESSAGES:
        hit = F.lower(message).rlike(pattern)
        category, retry = category.when(hit, label), retry.when(hit, F.lit(again))
    return category.otherwise("unknown"), retry.otherwise(F.lit(False))


def hide_paths(message: Column) -> Column:
    """Absolute paths in messages reduced to their last segment."""
    return F.regexp_replace(F.regexp_replace(message, r"[A-Za-z]:\\(?:[^\\\s:]+\\)*([^\\\s:]+)", "$1"), r"(?:/[^/\s:'\"]+)+/([^/\s:'\"]+)", "$1")
