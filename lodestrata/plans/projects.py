"""Queries: whole projects, guards of paths, the store's upkeep, and semantic search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import security
from lodestrata.operators import extraction, files, metrics, projects, services, store, trees, vector_search
from lodestrata.operators import symbols as nav
from lodestrata.plans import analysis, paths, services as service_plans
from lodestrata.plans.common import FILES, SYMBOLS, Query, quoted, rule_values, source, symbols
from lodestrata.sources.tables import path_repository, table

ROOT = "/srv/code"
MIGRATIONS = ((1, "DROP TABLE a"), (2, "DROP TABLE b"), (3, None), (5, "DROP TABLE e"))
BLOCK_LANGUAGES = ("javascript", "typescript", "java", "go")
BLOCK_KINDS = ("class", "struct", "namespace", "function", "method", "constructor")
APPLIED = (1, 2, 3, 4, 5)


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_changes").select("path").distinct()


def path_guards(spark: SparkSession, d: str) -> DataFrame:
    """Every path of an event: text file, below the roots, joined to a root from its repository's sister, and back from a URI."""
    p = F.col("path")
    full = F.concat(F.lit(ROOT + "/"), p)
    roots = [f"{ROOT}/{name}" for name in ("account", "vault-", "meter")]
    return _paths(spark, d).select(
        "path", security.is_text_file(p).alias("is_text"), security.is_within(full, [ROOT]).alias("allowed"), security.is_within(full, roots).alias("allowed_some"),
        security.safe_join(f"{ROOT}/x", F.concat(F.lit("./a//../"), p)).alias("joined"), security.safe_join(f"{ROOT}/x", F.concat(F.lit("../"), p)).alias("left_root"),
        security.uri_to_relative(F.concat(F.lit("file://"), full), ROOT).alias("relative"),
    )


def stored_patterns(spark: SparkSession, d: str) -> DataFrame:
    return store.pattern_to_detected(table(spark, d, "developer_patterns").select("id", "pattern_type", "name", "confidence", "frequency", "file_paths", "examples").distinct())


def store_rollback(spark: SparkSession, d: str) -> DataFrame:
    applied = spark.createDataFrame([(v,) for v in APPLIED], "version int")
    return store.rollback(applied, spark.createDataFrame(list(MIGRATIONS), "version int, down string"), 1).select("version", "statement", "place")


def key_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = source(spark, d)
    entries = files.entry_points(s).select(path_repository(F.col("path")).alias("repo"), "path", F.lit(0).alias("order"))
    others = s.where("language <> 'json'").select(path_repository(F.col("path")).alias("repo"), "path", F.lit(1).alias("order"))
    return projects.key_symbols(entries.unionByName(others), symbols(spark, d))


def learned_repositories(spark: SparkSession, d: str) -> DataFrame:
    repo = lambda c: path_repository(F.col(c)).alias("repo")
    concepts = table(spark, d, "semantic_concepts").select("id", "file_path").dropDuplicates(["id"]).select(repo("file_path"))
    patterns = table(spark, d, "developer_patterns").select("id", F.explode(store.json_strings("file_paths")).alias("p")).distinct().select(repo("p"))
    return projects.has_intelligence(projects.repositories(spark, _paths(spark, d)), concepts, patterns)


def blueprint_memory(spark: SparkSession, d: str) -> DataFrame:
    return projects.overview_text(services.blueprint(source(spark, d)))


def codebase_analysis(spark: SparkSession, d: str) -> DataFrame:
    s = source(spark, d)
    repo = path_repository(F.col("path")).alias("repo")
    measured = metrics.analyse(s.where(F.col("language").isin(*analysis.PROGRAMS)).select("path", "language", "content"), F.col("language")).select(repo, "cyclomatic", "maintainability")
    imports = extraction.imports(s).where("NOT is_stdlib").select(repo, (~F.col("is_relative")).alias("is_external"))
    return projects.analyse_projects(measured, imports, s.select(repo, "language"))


def merged_backends(spark: SparkSession, d: str) -> DataFrame:
    """Imports by two backends, the parser before the expressions: per file those of the first that found any."""
    known = projects.Backends()
    known.register("expressions", 10, lambda f: extraction.imports(f).select("path", "module"))
    known.register("parser", 50, lambda f: extraction.python_imports(f).select("path", "module"))
    return extraction.best_imports(known.extract(source(spark, d))).groupBy("path", "backend").agg(F.count(F.lit(1)).alias("n"))


def semantic_concepts_search(spark: SparkSession, d: str) -> DataFrame:
    """Concepts by the vectors of their texts, embedded in batches."""
    concepts = table(spark, d, "semantic_concepts").select("id", "name", "concept_type", "description").dropDuplicates(["id"])
    vectors = projects.embedded(concepts.select("id", F.concat_ws(" ", "concept_type", "name", "description").alias("text")), "text", projects.hashed_words)
    return services.search_codebase(vectors, "shared cache service", "semantic", 20, vectors=vectors, embed=lambda text: projects.hashed_words([text])[0])


def memory_semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """Memories (documents) by the product of unit vectors."""
    rows = projects.embedded(table(spark, d, "documents").select("doc_id", "text"), "text", projects.hashed_words)
    query = projects.hashed_words(["the cache is read again after a restart"])[0]
    return vector_search.search(rows, query, key="doc_id", limit=5, threshold=None)


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return trees.nodes(source(spark, d))


def parsed_symbols(spark: SparkSession, d: str) -> DataFrame:
    return trees.symbols(_tree(spark, d))


def confirmed_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The symbols that the parser finds at their line, of the languages with blocks."""
    known = symbols(spark, d).where(F.col("kind").isin(*BLOCK_KINDS) & F.col("language").isin(*BLOCK_LANGUAGES)).select("symbol_id", "path", "name", "start_line", "kind", "end_line")
    found = parsed_symbols(spark, d).where(F.col("language").isin(*BLOCK_LANGUAGES)).select("path", "name", "start_line", "kind", "end_line")
    return known.join(found, ["path", "name", "start_line", "kind", "end_line"], "left_semi").select("symbol_id")


def tree_query_counts(spark: SparkSession, d: str) -> DataFrame:
    return trees.search(_tree(spark, d), "class").groupBy("pattern", "type").agg(F.count(F.lit(1)).alias("n"))


def tree_query_custom(spark: SparkSession, d: str) -> DataFrame:
    return trees.match(_tree(spark, d), "calls", "python", "(call (attribute) @_callee (keyword) @argument)").groupBy("pattern", "text").agg(F.count(F.lit(1)).alias("n"))


def file_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return trees.diagnostics(_tree(spark, d))


def python_parameters(spark: SparkSession, d: str) -> DataFrame:
    return trees.parameters(_tree(spark, d))


def unique_symbols(spark: SparkSession, d: str) -> DataFrame:
    return nav.find_unique(symbols(spark, d).select("symbol_id", "name")).select("symbol_id", "name")


def symbol_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Where the names that symbols call their parents are defined."""
    s = symbols(spark, d).select("name", "path", "start_line", "kind", "parent")
    return nav.definitions(s.select(F.trim("parent").alias("name")), s)


def queries() -> dict[str, Query]:
    mine = (
        path_guards, stored_patterns, store_rollback, key_symbols, learned_repositories, blueprint_memory, codebase_analysis, merged_backends, semantic_concepts_search, memory_semantic_search,
        parsed_symbols, confirmed_symbols, tree_query_counts, tree_query_custom, file_diagnostics, python_parameters, unique_symbols, symbol_definitions)
    return {f.__name__: f for f in mine}


def oracle_sql() -> dict[str, str]:
    ext = ", ".join(map(quoted, security.TEXT_EXTENSIONS))
    names = ", ".join(map(quoted, security.TEXT_NAMES))
    strings = "CASE WHEN json_valid({0}) AND json_type({0}) = 'ARRAY' THEN CAST({0} AS VARCHAR[]) ELSE [] END"
    blueprint = service_plans.oracle_sql()["project_blueprint"]
    bullet = "list_transform(list_filter(string_split({0}, ','), lambda x: x <> ''), lambda x: '- ' || x)"
    return {
        "path_guards": f"""SELECT path, regexp_extract(lower(regexp_extract(path, '[^/]*$')), '[^.]\\.([^.]+)$', 1) IN ({ext}) OR lower(regexp_extract(path, '[^/]*$')) IN ({names}) AS is_text, true AS allowed,
              starts_with(path, 'account/') OR starts_with(path, 'vault-/') OR starts_with(path, 'meter/') AS allowed_some, '{ROOT}/x/' || path AS joined, NULL::VARCHAR AS left_root, path AS relative FROM (SELECT DISTINCT path FROM file_changes)""",
        "stored_patterns": f"""SELECT DISTINCT id, pattern_type, name, confidence, frequency, ({strings.format('file_paths')})[1] AS file_path, ({strings.format('examples')})[1] AS snippet FROM developer_patterns""",
        "store_rollback": f"""SELECT v.version::INT AS version, statement, row_number() OVER (ORDER BY v.version DESC)::INT AS place FROM {rule_values([(v,) for v in APPLIED], 'version')}
            LEFT JOIN {rule_values(list(MIGRATIONS), 'version, statement').replace(' AS v(', ' AS m(')} ON m.version = v.version WHERE v.version > 1""",
        "key_symbols": f"""WITH {FILES}, {SYMBOLS}, {paths._ENTRIES}, c AS (SELECT string_split(path, '/')[1] AS repo, path, min(o) AS o FROM (SELECT path, 0 AS o FROM ep UNION ALL SELECT path, 1 FROM files WHERE language <> 'json') GROUP BY 1, 2),
            f AS (SELECT repo, path FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY o, path) AS n FROM c) WHERE n <= 10),
            t AS (SELECT f.repo, s.path, name, kind, row_number() OVER (PARTITION BY s.path ORDER BY start_line, symbol_id)::INT AS place FROM syms s JOIN f ON f.path = s.path WHERE kind IN ('class', 'function', 'interface') AND trim(coalesce(parent, '')) = '')
            SELECT * FROM t WHERE place <= 20""",
        "learned_repositories": f"""WITH r AS (SELECT DISTINCT string_split(path, '/')[1] AS repo FROM file_changes), c AS (SELECT string_split(file_path, '/')[1] AS repo, count(DISTINCT id) AS n FROM semantic_concepts GROUP BY 1),
            p AS (SELECT string_split(p, '/')[1] AS repo, count(*) AS n FROM (SELECT DISTINCT id, p FROM (SELECT id, unnest({strings.format('file_paths')}) AS p FROM developer_patterns)) GROUP BY 1)
            SELECT r.repo, coalesce(c.n, 0)::BIGINT AS n_concepts, coalesce(p.n, 0)::BIGINT AS n_patterns, coalesce(c.n, 0) + coalesce(p.n, 0) > 0 AS learned FROM r LEFT JOIN c ON c.repo = r.repo LEFT JOIN p ON p.repo = r.repo""",
        "blueprint_memory": f"""WITH b AS ({blueprint}), l AS (SELECT repo, list_concat({bullet.format('languages')}, {bullet.format('frameworks')}) AS stack, style,
              list_transform(list_filter(string_split(directories, ','), lambda x: x <> ''), lambda x: '- `' || string_split(x, ':')[-1] || '/` — ' || string_split(x, ':')[1]) AS dirs FROM b)
            SELECT repo, array_to_string(list_concat(['# Project Overview', '', 'Auto-generated from codebase analysis.', ''], CASE WHEN len(stack) > 0 THEN list_concat(['## Tech Stack'], stack, ['']) ELSE [] END,
              CASE WHEN style <> '' THEN ['## Architecture', style, ''] ELSE [] END, CASE WHEN len(dirs) > 0 THEN list_concat(['## Key Directories'], dirs, ['']) ELSE [] END), chr(10)) AS text FROM l""",
        "confirmed_symbols": f"""WITH {FILES}, {SYMBOLS} SELECT symbol_id FROM syms s JOIN files f ON f.path = s.path WHERE s.kind IN ({', '.join(map(quoted, BLOCK_KINDS))}) AND s.language IN ({', '.join(map(quoted, BLOCK_LANGUAGES))})""",
        "unique_symbols": f"WITH {SYMBOLS} SELECT symbol_id, name FROM syms WHERE name IN (SELECT name FROM syms GROUP BY name HAVING count(*) = 1)",
        "symbol_definitions": f"WITH {SYMBOLS} SELECT name, path, start_line, kind FROM syms WHERE name IN (SELECT trim(parent, ' ') FROM syms)",
        "codebase_analysis": f"""WITH {FILES}, {analysis._PY}, {analysis._halstead_sql()}, lo AS ({analysis._loc_sql('py')}), {analysis._IMPORTS},
            m0 AS (SELECT hv.path, hv.volume, r.code AS code, {analysis._cyclomatic_all('hv.content')} AS cyc FROM hv JOIN lo ON lo.path = hv.path),
            cc AS (SELECT string_split(path, '/')[1] AS repo, sum(cyc)::DOUBLE / count(*) AS cyclomatic, sum(round({analysis._MI}, 4)::DECIMAL(18, 4))::DOUBLE / count(*) AS maintainability FROM m0 GROUP BY 1),
            f AS (SELECT string_split(path, '/')[1] AS repo, count(*) AS n_files, count(DISTINCT language) AS n_languages FROM files GROUP BY 1),
            e AS (SELECT string_split(path, '/')[1] AS repo, count(*) AS n_edges, count(*) FILTER (WHERE NOT is_relative) AS n_external FROM imp WHERE NOT is_stdlib GROUP BY 1)
            SELECT f.repo, n_files, n_languages, cyclomatic, maintainability, coalesce(n_edges, 0)::BIGINT AS n_edges, coalesce(n_external, 0)::BIGINT AS n_external FROM f LEFT JOIN cc USING (repo) LEFT JOIN e USING (repo)""",
    }
