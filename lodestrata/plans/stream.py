"""Queries: the change stream, in batch form and as streams that run to the end of the stored events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans.common import Query
from lodestrata.sources.tables import table
from lodestrata.streaming import changes

GAP_SECONDS = 7200


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_changes").select("change_id", "path", "event_type", "ts", "hash")


def _user_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("change_id"), F.col("user_id").alias("path"), "event_type", "ts")


def debounced(spark: SparkSession, d: str) -> DataFrame:
    return changes.debounce(_events(spark, d))


def debounced_users(spark: SparkSession, d: str) -> DataFrame:
    return changes.debounce(_user_events(spark, d), GAP_SECONDS).select(F.col("path").alias("user_id"), "n_events", F.col("change_id").alias("event_id"))


def content_changes(spark: SparkSession, d: str) -> DataFrame:
    return changes.changed(_events(spark, d)).select("path", "change_id", "event_type")


def move_events(spark: SparkSession, d: str) -> DataFrame:
    """Each path with its next path in the alphabet stands for a move."""
    e = table(spark, d, "file_changes").where("event_type = 'unlink'").select("ts", F.col("path").alias("source"), F.concat("path", F.lit(".moved")).alias("target")).distinct()
    return changes.moves(e)


def enriched_events(spark: SparkSession, d: str) -> DataFrame:
    """size is -1 for events without content."""
    e = table(spark, d, "file_changes").select("change_id", "path", "content").dropDuplicates(["change_id"])
    return changes.enrich(e).select("change_id", "language", F.coalesce("size", F.lit(-1)).alias("size"), "hash")


def watched_events(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    e = _events(spark, d).select("path").distinct()
    return e.where(~changes.should_ignore(path, ["node_modules/**", "*.min.js", "/vendor/"]) & changes.matches(path, ["*.py", "*.ts", "*.js"]))


def _run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    from lodestrata.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    view = f"{name}_{uuid.uuid4().hex[:8]}"
    out = f"{base}/streams/{view}"
    query = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")


def debounce_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    e = _stream(spark, d, "events").select(F.col("event_id").alias("change_id"), F.col("user_id").alias("path"), "event_type", "ts")
    return _run(spark, changes.debounce_stream(e, f"{GAP_SECONDS} seconds"), "debounce").select(F.col("path").alias("user_id"), "n_events", F.col("change_id").alias("event_id"))


def change_stream(spark: SparkSession, d: str) -> DataFrame:
    e = _stream(spark, d, "file_changes").select("change_id", "path", "event_type", "ts", "hash").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 days").dropDuplicates(["change_id", "ts"])
    return _run(spark, changes.changed_stream(e), "changes").select("path", "change_id", "event_type")


def queries() -> dict[str, Query]:
    return {
        "debounce_files": debounced, "debounce_users": debounced_users, "content_changes": content_changes, "move_events": move_events, "enriched_events": enriched_events,
        "watched_paths": watched_events, "debounce_stream": debounce_stream, "change_stream": change_stream,
    }


def _debounce_sql(relation: str, gap: str, out: str) -> str:
    return f"""WITH e AS (SELECT * FROM {relation}), r AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '{gap}' THEN 0 ELSE 1 END AS opened FROM e WINDOW w AS (PARTITION BY k ORDER BY ts, i)),
        g AS (SELECT *, sum(opened) OVER (PARTITION BY k ORDER BY ts, i) AS run FROM r) SELECT {out} FROM g GROUP BY k, run"""


def oracle_sql() -> dict[str, str]:
    one = "(SELECT DISTINCT change_id AS i, path AS k, event_type AS t, ts FROM file_changes)"
    changed = """WITH e AS (SELECT DISTINCT change_id, path, event_type, ts, hash FROM file_changes),
        s AS (SELECT *, last_value(CASE WHEN event_type = 'unlink' THEN '' ELSE hash END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ts, change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM e)
        SELECT path, change_id, event_type FROM s WHERE NOT (event_type = 'change' AND hash IS NOT NULL AND coalesce(known = hash, false))"""
    return {
        "debounce_files": _debounce_sql(one, "500 milliseconds", "k AS path, count(*) AS n_events, arg_max(i, (ts, i)) AS change_id, arg_max(t, (ts, i)) AS event_type, max(ts) AS ts"),
        "debounce_users": _debounce_sql("(SELECT event_id AS i, user_id AS k, ts FROM events)", f"{GAP_SECONDS} seconds", "k AS user_id, count(*) AS n_events, arg_max(i, (ts, i)) AS event_id"),
        "content_changes": changed,
        "change_stream": changed,
        "move_events": "SELECT ts, path, 'unlink' AS event_type FROM (SELECT DISTINCT ts, path FROM file_changes WHERE event_type = 'unlink') UNION ALL SELECT ts, path || '.moved', 'add' FROM (SELECT DISTINCT ts, path FROM file_changes WHERE event_type = 'unlink')",
        "enriched_events": """SELECT DISTINCT change_id, CASE lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'json' THEN 'json' ELSE 'unknown' END AS language,
            coalesce(strlen(content), -1)::BIGINT AS size, sha256(content) AS hash FROM file_changes""",
        "watched_paths": "SELECT DISTINCT path FROM file_changes WHERE NOT (contains(path, 'node_modules') OR contains(path, '.min.js') OR contains(path, 'vendor')) AND (ends_with(path, '.py') OR ends_with(path, '.ts') OR ends_with(path, '.js'))",
    }
