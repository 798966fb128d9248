"""Queries: predicates and functions on paths, names and languages, and project structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import languages, naming, security
from lodestrata.operators import files, rules
from lodestrata.plans.common import FILES, SYMBOLS, Query, quoted, source, symbols
from lodestrata.sources.tables import path_repository, table

SAMPLES = (
    "app/.env", "app/.env.local", "keys/server.pem", "home/id_rsa", "cfg/credentials.json", "a/.aws/config", "a/.ssh/known", "x/kubeconfig", "data/app.sqlite", "data/App.DB", "src/main.py",
    "node_modules/x/index.js", "pkg/x.egg-info/top.txt", "build/out.js", "lib/app.min.js", "Pods/a.m", "src/~x", "~/../etc/passwd", "a//b\\c", "con.txt", "notes.md", "a..b", "deep/dir/File.TSX", ".gitignore", "Makefile", "x.h++",
)


def _samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SAMPLES], "path string")


def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return _samples(spark).select(
        "path", security.is_sensitive(p).alias("sensitive"), security.sensitivity_reason(p).alias("reason"), security.is_ignored(p).alias("ignored"), security.is_scan_ignored(p).alias("scan_ignored"),
        languages.detect_language(p).alias("language"), security.sanitize_path(p).alias("sanitized"), security.is_safe_filename(p).alias("safe_name"), security.escape_like_column(p).alias("escaped"),
    )


def changed_paths_ignored(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    paths = table(spark, d, "file_changes").select("path").distinct()
    return paths.select("path", security.is_ignored(p).alias("ignored"), security.is_scan_ignored(p).alias("scan_ignored"), languages.is_code_path(p).alias("is_code"))


def language_names(spark: SparkSession, d: str) -> DataFrame:
    """The spellings of languages in parse results, normalised."""
    return table(spark, d, "parse_results").groupBy(languages.normalize_language(F.trim("language")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def language_registry(spark: SparkSession, d: str) -> DataFrame:
    return languages.registry(spark).select("name", "category", "typed", "compiled", F.array_join("extensions", ",").alias("extensions"))


def source_files(spark: SparkSession, d: str) -> DataFrame:
    return files.source_files(source(spark, d)).select("path", "language", F.octet_length("content").alias("size"))


def file_previews(spark: SparkSession, d: str) -> DataFrame:
    return files.preview(source(spark, d), 500).select("path", F.length("content").alias("n_chars"))


def extension_histogram(spark: SparkSession, d: str) -> DataFrame:
    return files.extension_histogram(source(spark, d))


def language_histogram(spark: SparkSession, d: str) -> DataFrame:
    return files.language_histogram(source(spark, d))


def key_directories(spark: SparkSession, d: str) -> DataFrame:
    return files.key_directories(source(spark, d))


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    return files.entry_points(source(spark, d))


def framework_use(spark: SparkSession, d: str) -> DataFrame:
    return files.frameworks(source(spark, d))


def architecture(spark: SparkSession, d: str) -> DataFrame:
    s = source(spark, d)
    repo = path_repository(F.col("path")).alias("repo")
    used = s.where(F.col("content").rlike(rules.java(r"import\s+asyncio|async\s+def")) & (F.col("language") == "python")).select(repo).distinct()
    return files.architecture_style(files.key_directories(s).select("repo", "directory_type"), files.entry_points(s).select(repo, "entry_type"), used)


def naming_styles(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).groupBy("kind", naming.naming_style(F.col("name")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


EXPECTED = {"python": "snake_case", "java": "camelCase", "javascript": "camelCase", "typescript": "camelCase", "go": "camelCase"}


def naming_violations(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods whose style is not the one expected in their language."""
    s = symbols(spark, d).where(F.col("kind").isin("function", "method")).withColumn("expected", languages.literal_map(EXPECTED)[F.col("language")])
    style = naming.naming_style(F.col("name"))
    return s.where(naming.violates(style, F.col("expected"))).select("symbol_id", "name", "expected", style.alias("actual"))


def queries() -> dict[str, Query]:
    return {
        "path_predicates": path_predicates, "path_ignored": changed_paths_ignored, "language_names": language_names, "language_registry": language_registry, "source_files": source_files,
        "file_previews": file_previews, "extension_histogram": extension_histogram, "language_histogram": language_histogram, "key_directories": key_directories, "entry_points": entry_points,
        "framework_use": framework_use, "architecture_styles": architecture, "naming_styles": naming_styles, "naming_violations": naming_violations,
    }


_LANGUAGE_MAP = "MAP {" + ", ".join(f"'{e}': '{n}'" for e, n in languages.EXTENSION_LANGUAGE.items()) + "}"
_ALIAS_MAP = "MAP {" + ", ".join(f"'{e}': '{n}'" for e, n in languages.ALIAS_LANGUAGE.items()) + "}"


def _list(values) -> str:  # noqa: ANN001
    return "[" + ", ".join(quoted(v) for v in values) + "]"


_EXT = r"lower(regexp_extract(path, '[^/\\]\.([^./\\]+)$', 1))"
_SENSITIVE = f"regexp_matches(replace(path, '\\', '/'), {quoted(security.any_of(security.SENSITIVE))})"
_PARTS = "string_split(replace(path, '\\', '/'), '/')"
_IGNORED = f"(list_has_any({_PARTS}, {_list(security.IGNORED_DIRS)}) OR len(list_filter({_PARTS}, lambda p: ends_with(p, '.egg-info'))) > 0 OR {_SENSITIVE})"
_NAME = f"{_PARTS}[-1]"
_SCAN = (
    f"(list_has_any({_PARTS}, {_list(security.SCAN_IGNORED_DIRS)}) OR list_contains({_list(n for n in security.SCAN_IGNORED_NAMES if '*' not in n)}, {_NAME}) OR "
    + " OR ".join(f"ends_with({_NAME}, {quoted(n[1:])})" for n in security.SCAN_IGNORED_NAMES if n.startswith("*"))
    + ")"
)
_BARE = "regexp_replace(name, '^_+', '')"
_STYLE = f"CASE WHEN name IS NULL OR {_BARE} = '' THEN 'unknown' " + " ".join(f"WHEN regexp_matches({_BARE}, {quoted(p)}) THEN '{label}'" for label, p in naming.STYLES) + " ELSE 'mixed' END"
_DIRECTORY = "CASE " + " ".join(f"WHEN lower(directory) IN ({', '.join(map(quoted, names.split()))}) THEN '{label}'" for label, names in rules.DIRECTORY_TYPES) + " ELSE 'other' END"
_KEY_DIRS = f"""kd AS (SELECT repo, directory, n_files, {_DIRECTORY} AS directory_type FROM (
    SELECT string_split(path, '/')[1] AS repo, string_split(path, '/')[2] AS directory, count(*) AS n_files FROM files WHERE len(string_split(path, '/')) > 2 GROUP BY 1, 2)
    WHERE NOT starts_with(directory, '.') AND lower(directory) NOT IN ({', '.join(map(quoted, security.IGNORED_DIRS))}))"""
_ENTRY_NAME = "string_split(path, '/')[-1]"
_ENTRIES = f"""ep AS (SELECT path, coalesce(named, ruled) AS entry_type, CASE WHEN named IS NULL THEN text END AS description FROM (
    SELECT path, CASE WHEN {_ENTRY_NAME} IN ({', '.join(map(quoted, rules.ENTRY_FILES))}) THEN CASE WHEN contains({_ENTRY_NAME}, 'cli') THEN 'cli' WHEN contains({_ENTRY_NAME}, 'app') OR contains({_ENTRY_NAME}, 'server') THEN 'api' ELSE 'main' END END AS named,
      CASE {' '.join(f"WHEN regexp_matches(content, {quoted(p)}) THEN '{k}'" for k, _, p in rules.ENTRY_RULES)} END AS ruled,
      CASE {' '.join(f"WHEN regexp_matches(content, {quoted(p)}) THEN '{t}'" for _, t, p in rules.ENTRY_RULES)} END AS text FROM files) WHERE coalesce(named, ruled) IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    from lodestrata.plans.common import rule_values

    reasons = " ".join(f"WHEN regexp_matches(replace(path, '\\', '/'), {quoted('(?i)' + p)}) THEN {quoted(r)}" for p, r in security.SENSITIVE_REASONS)
    values = ", ".join(f"({quoted(s)})" for s in SAMPLES)
    expected = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in EXPECTED.items()) + "}"
    return {
        "path_predicates": f"""SELECT path, {_SENSITIVE} AS sensitive, CASE {reasons} END AS reason, {_IGNORED} AS ignored, {_SCAN} AS scan_ignored, coalesce({_LANGUAGE_MAP}[{_EXT}], 'unknown') AS language,
            regexp_replace(regexp_replace(regexp_replace(path, '^~+', ''), '\\.\\.[\\\\/]?', '', 'g'), '[\\\\/]+', '/', 'g') AS sanitized,
            NOT (regexp_matches(path, '[/\\\\]') OR contains(path, '..') OR list_contains({_list(security.RESERVED_NAMES)}, upper(string_split(path, '.')[1]))) AS safe_name,
            regexp_replace(path, '([\\\\%_])', '\\\\\\1', 'g') AS escaped FROM (VALUES {values}) AS v(path)""",
        "path_ignored": f"SELECT path, {_IGNORED} AS ignored, {_SCAN} AS scan_ignored, list_contains({_list(languages.CODE_EXTENSIONS)}, {_EXT}) AS is_code FROM (SELECT DISTINCT path FROM file_changes)",
        "language_names": f"SELECT coalesce({_ALIAS_MAP}[lower(trim(language))], trim(language)) AS language, count(*) AS n FROM parse_results GROUP BY 1",
        "language_registry": "SELECT * FROM " + rule_values([(n, c, t, k, ",".join(e.split())) for n, c, t, k, e, _ in languages.LANGUAGES], "name, category, typed, compiled, extensions"),
        "source_files": f"WITH {FILES} SELECT path, language, strlen(content)::INT AS size FROM files WHERE list_contains({_list(languages.CODE_EXTENSIONS)}, {_EXT}) AND NOT {_IGNORED} AND strlen(content) <= 1000000",
        "file_previews": f"WITH {FILES} SELECT path, least(length(content), 500)::INT AS n_chars FROM files WHERE NOT {_SENSITIVE} AND strlen(content) <= 1000000",
        "extension_histogram": f"WITH {FILES} SELECT {_EXT} AS extension, count(*) AS n_files FROM files GROUP BY 1",
        "language_histogram": f"WITH {FILES} SELECT language, count(*) AS n_files FROM files WHERE language <> 'unknown' GROUP BY 1",
        "key_directories": f"WITH {FILES}, {_KEY_DIRS} SELECT repo, directory, directory_type, n_files FROM kd",
        "entry_points": f"WITH {FILES}, {_ENTRIES} SELECT path, entry_type, description FROM ep",
        "framework_use": f"WITH {FILES} SELECT v.language, framework, count(DISTINCT path) AS n_files FROM files f, {rule_values(list(rules.FRAMEWORK_RULES), 'language, framework, pattern')} WHERE v.language = f.language AND regexp_matches(content, pattern) GROUP BY 1, 2",
        "architecture_styles": f"""WITH {FILES}, {_KEY_DIRS}, {_ENTRIES}, k AS (SELECT repo, list(DISTINCT directory_type) AS kinds FROM kd GROUP BY repo),
            c AS (SELECT DISTINCT string_split(path, '/')[1] AS repo FROM ep WHERE entry_type = 'cli'), u AS (SELECT DISTINCT string_split(path, '/')[1] AS repo FROM files WHERE language = 'python' AND regexp_matches(content, 'import\\s+asyncio|async\\s+def'))
            SELECT repo, CASE WHEN list_has_all(kinds, ['models', 'services', 'api']) THEN 'Layered/Service-Oriented' WHEN list_contains(kinds, 'api') AND repo IN (SELECT repo FROM u) THEN 'API-First'
              WHEN list_contains(kinds, 'tests') THEN CASE WHEN repo IN (SELECT repo FROM c) THEN 'CLI Application' ELSE 'Library/Package' END END AS style FROM k""",
        "naming_styles": f"WITH {SYMBOLS} SELECT kind, {_STYLE} AS style, count(*) AS n FROM syms GROUP BY 1, 2",
        "naming_violations": f"""WITH {SYMBOLS}, x AS (SELECT symbol_id, name, {expected}[language] AS expected, {_STYLE} AS actual FROM syms WHERE kind IN ('function', 'method'))
            SELECT * FROM x WHERE actual <> expected AND actual <> 'unknown' AND NOT (expected = 'snake_case' AND actual = 'flat_case')""",
    }
