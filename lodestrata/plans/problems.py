"""Queries of the general problems: orphan references (2) and hierarchies (3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.paths import normalize_path
from lodestrata.operators import hierarchy, orphans
from lodestrata.sources.tables import FILE_EVENTS, table

Query = Callable[[SparkSession, str], DataFrame]


def project_references(spark: SparkSession, directory: str) -> DataFrame:
    """The references of the three fields: sessions of decisions, and files of decisions and patterns."""
    session = F.lower(F.regexp_replace("session_id", r"^\s+|\s+$", ""))
    sessions = table(spark, directory, "project_decisions").select(
        F.lit("project_decisions").alias("table_name"), F.col("id").alias("record_id"), F.lit("session").alias("kind"), session.alias("key"), F.col("created_at").alias("at")
    )

    def paths(name: str, column: str) -> DataFrame:
        return table(spark, directory, name).select(
            F.lit(name).alias("table_name"), F.col("id").alias("record_id"), F.lit("file").alias("kind"),
            F.explode(F.from_json(column, "array<string>")).alias("raw"), F.col("created_at").alias("at"),
        ).select("table_name", "record_id", "kind", normalize_path(F.col("raw")).alias("key"), "at")

    files = paths("architectural_decisions", "related_files").unionByName(paths("developer_patterns", "file_paths"))
    return sessions.unionByName(files).where("key <> ''")


def project_parents(spark: SparkSession, directory: str) -> DataFrame:
    """Sessions exist from their start on, files from an add or change until an unlink."""
    started = table(spark, directory, "work_sessions").select(
        F.lit("session").alias("kind"), F.lower(F.regexp_replace("id", r"^\s+|\s+$", "")).alias("key"), F.col("started_at").alias("at"),
        F.lit(0).cast("long").alias("seq"), F.lit(True).alias("alive"),
    )
    events = table(spark, directory, "file_changes").where(F.col("event_type").isin(*FILE_EVENTS)).select(
        F.lit("file").alias("kind"), normalize_path(F.col("path")).alias("key"), F.col("ts").alias("at"),
        F.col("change_id").alias("seq"), (F.col("event_type") != "unlink").alias("alive"),
    )
    return started.unionByName(events).distinct()


def found_orphans(spark: SparkSession, directory: str) -> DataFrame:
    return orphans.orphan_references(project_references(spark, directory), project_parents(spark, directory))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return found_orphans(spark, directory).select("table_name", "record_id", "target").distinct()


def p2_report(spark: SparkSession, directory: str) -> DataFrame:
    return orphans.orphan_report(found_orphans(spark, directory))


def symbol_links(spark: SparkSession, directory: str) -> DataFrame:
    return hierarchy.name_links(
        table(spark, directory, "symbols").select(F.col("file_path").alias("group"), F.col("symbol_id").alias("id"), "name", "parent", "children")
    )


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    pairs = hierarchy.ancestor_pairs(symbol_links(spark, directory))
    return pairs.select(F.least("id", "ancestor").alias("symbol_a"), F.greatest("id", "ancestor").alias("symbol_b")).distinct()


def p3_hierarchy(spark: SparkSession, directory: str) -> DataFrame:
    return hierarchy.hierarchies(symbol_links(spark, directory)).select(
        F.col("group").alias("file_path"), F.col("id").alias("symbol_id"), "name", F.col("root").alias("root_id"), "depth", "path", "n_descendants", "cyclic"
    )


def p3_descendants(spark: SparkSession, directory: str) -> DataFrame:
    """Every symbol with each of its descendants; on a circle a symbol is its own."""
    pairs = hierarchy.ancestor_pairs(symbol_links(spark, directory))
    return pairs.select(F.col("ancestor").alias("symbol_id"), F.col("id").alias("descendant_id"), "distance")


def p3_cycles(spark: SparkSession, directory: str) -> DataFrame:
    """The links that run in a circle."""
    return hierarchy.circles(symbol_links(spark, directory)).select(
        F.col("group").alias("file_path"), F.col("id").alias("symbol_id"), "parent_id", F.col("circle").alias("cycle_id"), "length"
    )


def queries() -> dict[str, Query]:
    return {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_descendants": p3_descendants, "p3_cycles": p3_cycles}


_REFERENCES = r"""
refs AS (
  SELECT 'project_decisions' AS table_name, id AS record_id, 'session' AS kind, lower(trim(session_id, E' \t\n\r')) AS k, created_at AS t FROM project_decisions
  UNION ALL
  SELECT table_name, record_id, 'file',
         regexp_replace(regexp_replace(array_to_string(list_filter(string_split(replace(trim(p, E' \t\n\r'), '\', '/'), '/'), lambda s: s NOT IN ('', '.')), '/'),
           '[^/]+/\.\./', '', 'g'), '[^/]+/\.\./', '', 'g'), t
  FROM (
    SELECT 'architectural_decisions' AS table_name, id AS record_id, created_at AS t,
           unnest(CASE WHEN json_valid(related_files) AND json_type(related_files) = 'ARRAY' THEN CAST(related_files AS VARCHAR[]) END) AS p FROM architectural_decisions
    UNION ALL
    SELECT 'developer_patterns', id, created_at,
           unnest(CASE WHEN json_valid(file_paths) AND json_type(file_paths) = 'ARRAY' THEN CAST(file_paths AS VARCHAR[]) END) FROM developer_patterns
  )
),
parents AS (
  SELECT 'session' AS kind, lower(trim(id, E' \t\n\r')) AS k, started_at AS t, true AS alive FROM work_sessions
  UNION ALL
  SELECT 'file', path, ts, event_type <> 'unlink' FROM file_changes WHERE event_type IN ('add', 'change', 'unlink')
),
states AS (
  SELECT DISTINCT r.table_name, r.record_id, r.kind, r.k, r.t,
         (SELECT arg_max(p.alive, p.t) FROM parents p WHERE p.kind = r.kind AND p.k = r.k AND p.t <= r.t) AS alive,
         (SELECT min(p.t) FROM parents p WHERE p.kind = r.kind AND p.k = r.k AND p.alive) AS first_at
  FROM (SELECT DISTINCT * FROM refs WHERE k <> '') r
)
"""

_LINKS = r"""
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY symbol_id) AS rn FROM symbols) WHERE rn = 1),
named AS (SELECT file_path, symbol_id, name, children, nullif(trim(parent, E' \t\n\r'), '') AS wanted FROM s),
links AS (
  SELECT n.symbol_id AS id, n.name,
         coalesce(
           (SELECT min(m.symbol_id) FROM named m WHERE m.file_path = n.file_path AND m.name = n.wanted),
           (SELECT min(m.symbol_id) FROM named m WHERE m.file_path = n.file_path AND m.name = trim(regexp_extract(n.wanted, '([^.$#/:]*)$', 1))),
           CASE WHEN n.wanted IS NULL THEN
             (SELECT min(c.symbol_id) FROM (SELECT file_path, symbol_id, trim(unnest(children), E' \t\n\r') AS child FROM named) c
              WHERE c.file_path = n.file_path AND c.child = n.name) END) AS parent_id
  FROM named n
),
pairs AS (
  SELECT id, parent_id AS ancestor FROM links WHERE parent_id IS NOT NULL
  UNION
  SELECT p.id, l.parent_id FROM pairs p JOIN links l ON l.id = p.ancestor WHERE l.parent_id IS NOT NULL
)
"""

_CHAINS = f"""{_LINKS},
chains AS (
  SELECT id, parent_id AS ancestor, [parent_id] AS up FROM links WHERE parent_id IS NOT NULL
  UNION ALL
  SELECT c.id, l.parent_id, list_append(c.up, l.parent_id) FROM chains c JOIN links l ON l.id = c.ancestor
  WHERE l.parent_id IS NOT NULL AND NOT list_contains(c.up, l.parent_id)
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"WITH {_REFERENCES} SELECT DISTINCT table_name, record_id, k AS target FROM states WHERE alive IS NOT TRUE",
        "p2_report": f"""WITH {_REFERENCES}, dead AS (
            SELECT *, CASE WHEN first_at IS NULL THEN 'missing' WHEN first_at <= t THEN 'deleted' ELSE 'late' END AS reason FROM states WHERE alive IS NOT TRUE)
            SELECT table_name, strftime(t, '%Y-%m') AS month, reason, count(*) AS n_references, count(DISTINCT record_id) AS n_records
            FROM dead GROUP BY ALL""",
        "p3_found": f"WITH RECURSIVE {_LINKS} SELECT DISTINCT least(id, ancestor) AS symbol_a, greatest(id, ancestor) AS symbol_b FROM pairs",
        "p3_hierarchy": f"""WITH RECURSIVE {_CHAINS},
            bad AS (SELECT DISTINCT c.id FROM chains c JOIN (SELECT DISTINCT id FROM chains WHERE id = ancestor) o ON o.id = c.ancestor),
            longest AS (SELECT id, arg_max(up, len(up)) AS up FROM chains GROUP BY id),
            spread AS (SELECT id, unnest(up) AS a, unnest(range(len(up))) AS k FROM longest),
            above AS (SELECT s.id, string_agg(coalesce(l.name, ''), '/' ORDER BY s.k DESC) AS names FROM spread s JOIN links l ON l.id = s.a GROUP BY s.id),
            below AS (SELECT ancestor AS id, count(*) AS n FROM chains GROUP BY ancestor)
            SELECT n.file_path, l.id AS symbol_id, l.name, CASE WHEN bad.id IS NULL THEN coalesce(longest.up[-1], l.id) END AS root_id,
                   CASE WHEN bad.id IS NULL THEN coalesce(len(longest.up), 0) END AS depth,
                   CASE WHEN bad.id IS NULL THEN coalesce(above.names || '/', '') || coalesce(l.name, '') END AS path,
                   coalesce(below.n, 0) AS n_descendants, bad.id IS NOT NULL AS cyclic
            FROM links l JOIN named n ON n.symbol_id = l.id LEFT JOIN bad ON bad.id = l.id LEFT JOIN longest ON longest.id = l.id
            LEFT JOIN above ON above.id = l.id LEFT JOIN below ON below.id = l.id""",
        "p3_descendants": f"WITH RECURSIVE {_CHAINS} SELECT ancestor AS symbol_id, id AS descendant_id, len(up) AS distance FROM chains",
        "p3_cycles": f"""WITH RECURSIVE {_CHAINS} SELECT n.file_path, c.id AS symbol_id, l.parent_id, list_min(c.up) AS cycle_id, len(c.up) AS length
            FROM chains c JOIN links l ON l.id = c.id JOIN named n ON n.symbol_id = c.id WHERE c.id = c.ancestor""",
    }
