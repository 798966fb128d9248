"""Source files and what their paths and texts tell about a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import languages, security
from lodestrata.operators import rules

#: Files above this size are not learnt from; previews are cut at PREVIEW.
MAX_FILE_SIZE = 1_000_000
PREVIEW = 50_000


def read_tree(spark: SparkSession, root: str, language: str | None = None) -> DataFrame:
    """(path, size, mtime, content) of the files under a directory; a language narrows the scan to its extensions.

    The extension filter and the skipped size are applied before contents are decoded.
    """
    known = languages.extensions_of(language) if language else list(languages.CODE_EXTENSIONS)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(known or [language or ""]) + "}")
    return reader.load(root).where(F.col("length") <= MAX_FILE_SIZE).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def source_files(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """Code files that are neither ignored nor sensitive nor too large, with their language; the first max_files by path."""
    path = F.col("path")
    kept = files.where(languages.is_code_path(path) & ~security.is_ignored(path) & (F.octet_length("content") <= MAX_FILE_SIZE)).withColumn("language", languages.detect_language(path))
    return kept.orderBy("path").limit(max_files) if max_files is not None else kept


def preview(files: DataFrame, size: int = PREVIEW) -> DataFrame:
    """(path, content) cut at min(size, PREVIEW); sensitive and oversized files are left out."""
    return files.where(~security.is_sensitive(F.col("path")) & (F.octet_length("content") <= MAX_FILE_SIZE)).select("path", F.substring("content", 1, min(size, PREVIEW)).alias("content"))


def extension_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(languages.extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("n_files"))


def language_histogram(files: DataFrame) -> DataFrame:
    """Files per known language."""
    return files.groupBy(languages.detect_language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n_files")).where("language <> 'unknown'")


def directory_type(name: Column) -> Column:
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, names in rules.DIRECTORY_TYPES:
        kind = kind.when(F.lower(name).isin(*names.split()), label)
    return kind.otherwise("other")


def key_directories(files: DataFrame) -> DataFrame:
    """(repo, directory, directory_type, n_files) of the directories directly under a repository that hold files."""
    parts = F.split("path", "/")
    top = files.where(F.size(parts) > 2).select(parts[0].alias("repo"), parts[1].alias("directory"))
    kept = top.where(~F.col("directory").startswith(".") & ~F.lower("directory").isin(*security.IGNORED_DIRS))
    return kept.groupBy("repo", "directory").agg(F.count(F.lit(1)).alias("n_files")).withColumn("directory_type", directory_type(F.col("directory")))


def entry_points(files: DataFrame) -> DataFrame:
    """(path, entry_type, description): by name, else by the first content rule that fits."""
    name = F.element_at(F.split("path", "/"), -1)
    by_name = F.when(name.isin(*rules.ENTRY_FILES), F.when(name.contains("cli"), "cli").when(name.contains("app") | name.contains("server"), "api").otherwise("main"))
    by_rule = F.when(F.lit(False), F.lit(None).cast("string"))
    described = by_rule
    for kind, description, pattern in rules.ENTRY_RULES:
        hit = F.col("content").rlike(rules.java(pattern))
        by_rule, described = by_rule.when(hit, kind), described.when(hit, description)
    found = files.select("path", by_name.alias("named"), by_rule.alias("ruled"), described.alias("text"))
    return found.select("path", F.coalesce("named", "ruled").alias("entry_type"), F.when(F.col("named").isNull(), F.col("text")).alias("description")).where("entry_type IS NOT NULL")


def frameworks(files: DataFrame) -> DataFrame:
    """(language, framework, n_files): files of a language whose text fits a framework's rule."""
    language = languages.detect_language(F.col("path"))
    hits = F.array_compact(F.array(*[F.when((F.col("language") == lang) & F.col("content").rlike(rules.java(pattern)), F.lit(name)) for lang, name, pattern in rules.FRAMEWORK_RULES]))
    found = files.withColumn("language", language).select("path", "language", F.explode(F.array_distinct(hits)).alias("framework"))
    return found.groupBy("language", "framework").agg(F.count_distinct("path").alias("n_files"))


def architecture_style(directories: DataFrame, entries: DataFrame, used: DataFrame) -> DataFrame:
    """(repo, style): layered with models, services and api; API-first with api and frameworks; CLI application or library with
    tests; null else. directories: (repo, directory_type), entries: (repo, entry_type), used: (repo)."""
    kinds = directories.groupBy("repo").agg(F.collect_set("directory_type").alias("kinds"))
    cli = entries.where("entry_type = 'cli'").select("repo").distinct().withColumn("cli", F.lit(True))
    framed = used.select("repo").distinct().withColumn("framed", F.lit(True))
    has = lambda *k: F.size(F.array_except(F.array(*map(F.lit, k)), F.col("kinds"))) == 0
    style = (
        F.when(has("models", "services", "api"), "Layered/Service-Oriented")
        .when(has("api") & F.col("framed"), "API-First")
        .when(has("tests"), F.when(F.col("cli"), "CLI Application").otherwise("Library/Package"))
    )
    return kinds.join(cli, "repo", "left").join(framed, "repo", "left").select("repo", style.alias("style"))
