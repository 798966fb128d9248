"""Queries: compositions of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import rules, services
from lodestrata.plans import analysis, paths, search
from lodestrata.plans.common import FILES, Query, distinct, quoted, rule_values, source, symbols

INSIGHTS = (
    ("1", "bug", '{"title": "Null check", "reasoning": "seen twice", "fix": "guard"}', 0.9, False, False), ("2", "practice", '{"practice": "Small files", "description": "shorter", "suggested_action": "split"}', 0.5, True, False),
    ("3", "note", "broken", 0.1, True, True), ("4", "note", "{}", 0.2, False, True),
)


def search_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Semantic search without an embedder falls back to text search."""
    return services.search_codebase(source(spark, d), search.TEXT, "semantic", 50, "python")


def search_dispatch_pattern(spark: SparkSession, d: str) -> DataFrame:
    return services.search_codebase(source(spark, d), "py_class", "pattern", 9999)


def learned_concepts(spark: SparkSession, d: str) -> DataFrame:
    return services.learn(source(spark, d))["concepts"]


def learned_patterns(spark: SparkSession, d: str) -> DataFrame:
    return services.learn(source(spark, d))["patterns"]


def project_blueprint(spark: SparkSession, d: str) -> DataFrame:
    return services.blueprint(source(spark, d))


def system_status(spark: SparkSession, d: str) -> DataFrame:
    tables = {"semantic_concepts": distinct(spark, d, "semantic_concepts", "concept_type", "confidence"), "developer_patterns": distinct(spark, d, "developer_patterns", "pattern_type", "confidence")}
    return services.system_status(tables, {"semantic_concepts": "concept_type", "developer_patterns": "pattern_type"})


def investigated_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d).where("kind IN ('function', 'method', 'constructor') AND language = 'python'")
    return services.investigate(s, source(spark, d).where("language = 'python'")).select("symbol_id", "name", "style", "cyclomatic", "cyclomatic_level", "cognitive", "cognitive_level", F.round("maintainability", 2).alias("maintainability"))


def contributed_insights(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(list(INSIGHTS), "id string, insight_type string, content string, confidence double, acknowledged boolean, resolved boolean")
    return services.contributed_insights(rows)


def unresolved_insights(spark: SparkSession, d: str) -> DataFrame:
    return services.unresolved(contributed_insights(spark, d)).select("id", "status")


def queries() -> dict[str, Query]:
    mine = (search_dispatch, search_dispatch_pattern, learned_concepts, learned_patterns, project_blueprint, system_status, investigated_symbols, contributed_insights, unresolved_insights)
    return {f.__name__: f for f in mine}


def oracle_sql() -> dict[str, str]:
    expected = (
        ("1", "bug", "Null check", "seen twice", "guard", 0.9, "pending"), ("2", "practice", "Small files", "shorter", "split", 0.5, "acknowledged"), ("3", "note", "note", "broken", "", 0.1, "resolved"), ("4", "note", "note", "{}", "", 0.2, "resolved"),
    )
    insight_rows = rule_values(list(expected), "id, insight_type, title, description, suggested_action, confidence, status")
    pattern = "(?m)^class\\s+(\\w+)(?:\\(([^)]*)\\))?:"
    return {
        "search_dispatch": f"WITH {FILES}, t AS ({search._text_sql(chr(40) + 'SELECT * FROM files WHERE language = ' + quoted('python') + chr(41), 'path', search.TEXT)}) SELECT path AS key, score, 'text' AS search_type FROM t",
        "search_dispatch_pattern": f"""WITH {FILES}, r AS (SELECT path, len(regexp_extract_all(content, {quoted(pattern)})) AS n, len(regexp_extract_all(content, '(?im)py_class')) AS own, language FROM files),
            m AS (SELECT path, CASE WHEN language = 'python' AND n > 0 THEN n ELSE own END AS n FROM r)
            SELECT path AS key, round(0.6 * least(n / 10.0, 1.0) + 0.4 * least(1 / 5.0, 1.0), 6)::DOUBLE AS score, 'pattern' AS search_type FROM m WHERE n > 0 ORDER BY score DESC, n DESC, path LIMIT 500""",
        "learned_concepts": f"WITH {FILES} SELECT substring(sha256(concat_ws(':', name, concept_type, path)), 1, 16) AS id, name, concept_type, path AS file_path, confidence, n AS occurrences FROM ({analysis._concepts_sql()})",
        "learned_patterns": f"WITH {FILES}, {analysis._detect_sql(0.5)} SELECT substring(sha256(concat_ws(':', pattern_type, path)), 1, 16) AS id, pattern_type, path AS file_path, confidence, frequency FROM det",
        "project_blueprint": f"""WITH {FILES}, {paths._KEY_DIRS}, {paths._ENTRIES}, r AS (SELECT *, string_split(path, '/')[1] AS repo FROM files),
            fw AS (SELECT DISTINCT repo, framework FROM r, {rule_values(list(rules.FRAMEWORK_RULES), 'lang, framework, pattern')} WHERE lang = language AND regexp_matches(content, pattern)),
            b AS (SELECT repo, count(*) AS n_files, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages FROM r GROUP BY 1), f AS (SELECT repo, array_to_string(list_sort(list(framework)), ',') AS frameworks FROM fw GROUP BY 1),
            t AS (SELECT repo, array_to_string(list_sort(list(DISTINCT directory_type || ':' || directory)), ',') AS directories FROM kd WHERE directory_type <> 'other' GROUP BY 1),
            e AS (SELECT string_split(path, '/')[1] AS repo, count(*) AS n, bool_or(entry_type = 'cli') AS cli FROM ep GROUP BY 1), k AS (SELECT repo, list(DISTINCT directory_type) AS kinds FROM kd GROUP BY 1)
            SELECT b.repo, n_files, languages, coalesce(frameworks, '') AS frameworks, coalesce(directories, '') AS directories, coalesce(n, 0)::BIGINT AS n_entry_points,
              coalesce(CASE WHEN list_has_all(kinds, ['models', 'services', 'api']) THEN 'Layered/Service-Oriented' WHEN list_contains(kinds, 'api') AND frameworks IS NOT NULL THEN 'API-First'
                WHEN list_contains(kinds, 'tests') THEN CASE WHEN cli THEN 'CLI Application' ELSE 'Library/Package' END END, '') AS style
            FROM b LEFT JOIN f USING (repo) LEFT JOIN t USING (repo) LEFT JOIN e USING (repo) LEFT JOIN k USING (repo)""",
        "system_status": """WITH c AS (SELECT DISTINCT * FROM semantic_concepts), p AS (SELECT DISTINCT * FROM developer_patterns)
            SELECT 'tables' AS section, 'semantic_concepts' AS item, count(*) AS n, NULL::DOUBLE AS confidence FROM c UNION ALL SELECT 'tables', 'developer_patterns', count(*), NULL FROM p
            UNION ALL SELECT 'semantic_concepts', concept_type, count(*), round(avg(confidence), 6) FROM c GROUP BY 2 UNION ALL SELECT 'developer_patterns', pattern_type, count(*), round(avg(confidence), 6) FROM p GROUP BY 2""",
        "investigated_symbols": f"""WITH {analysis._BODIES}, py AS (SELECT symbol_id::VARCHAR AS path, body AS content, language FROM fb), {analysis._halstead_sql()}, lo AS ({analysis._loc_sql('py')}),
            m0 AS (SELECT hv.path, hv.volume, r.code AS code, {analysis._cyclomatic_sql('hv.content', 'python')} AS cyc, {analysis._cognitive_sql('hv.content')} AS cog FROM hv JOIN lo ON lo.path = hv.path),
            m AS (SELECT fb.symbol_id, fb.name, cyc, cog, round(round({analysis._MI}, 4)::DECIMAL(18, 4), 2)::DOUBLE AS mi FROM m0 JOIN fb ON fb.symbol_id::VARCHAR = m0.path)
            SELECT symbol_id, name, {paths._STYLE} AS style, cyc AS cyclomatic, {analysis._level_sql('cyc', (10, 20, 50))} AS cyclomatic_level, cog AS cognitive, {analysis._level_sql('cog', (5, 15, 25))} AS cognitive_level, mi AS maintainability FROM m""",
        "contributed_insights": f"SELECT id, insight_type, title, description, suggested_action, confidence::DOUBLE AS confidence, status FROM {insight_rows}",
        "unresolved_insights": "SELECT * FROM (VALUES ('1', 'pending'), ('2', 'acknowledged')) AS v(id, status)",
    }
