"""Navigation and editing of symbols."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.naming import PREFIXES, naming_style
from lodestrata.operators.text_search import strip

#: Parts of paths that put a reference into a category, in the order in which they are tried.
REFERENCE_CATEGORIES = (
    ("test", ("test", "spec", "fixture", "conftest")),
    ("config", ("config", "settings", "env", ".cfg", ".ini", ".toml", ".yaml", ".yml")),
    ("source", ("src/", "lib/", "app/", "pkg/")),
)
SOURCE_ENDS = (".py", ".ts", ".rs")
#: Beginnings of import lines.
IMPORT_STARTS = r"^(?:import |from |#include|require\(|using |use |const .*require|export .*from |package )"


def name_parts(qualified: Column, parent: Column, name: Column) -> Column:
    """Name path of a symbol: the segments of its qualified name, else parent and name."""
    return F.when(qualified.isNotNull() & (qualified != ""), F.split(qualified, r"\.")).otherwise(F.array_compact(F.array(F.nullif(F.trim(parent), F.lit("")), name)))


def find(symbols: DataFrame, pattern: str, substring: bool = False, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Symbols (…, parts, overload) whose name path fits: ``a/b`` as its end, ``/a/b`` as a whole, ``b[2]`` the overload of that
    index; with substring the last part may be a piece of the name, whatever its case."""
    index = re.fullmatch(r"(.*)\[(\d+)\]", pattern)
    wanted = index.group(1) if index else pattern
    absolute = wanted.startswith("/")
    parts = wanted.lstrip("/").split("/") if wanted.lstrip("/") else []
    if not parts:
        return symbols.where(F.lit(False))
    size = F.size("parts")
    fits = size == len(parts) if absolute else size >= len(parts)
    tail = F.slice("parts", F.greatest(size - len(parts) + 1, F.lit(1)), len(parts))
    for i, part in enumerate(parts):
        actual = F.get(tail, i)
        fits = fits & (F.lower(actual).contains(part.lower()) if substring and i == len(parts) - 1 else actual == part)
    if index:
        fits = fits & (F.col("overload") == int(index.group(2)))
    found = symbols.where(fits)
    if include:
        found = found.where(F.col("kind").isin(*include))
    return found.where(~F.col("kind").isin(*exclude)) if exclude else found


def overview(symbols: DataFrame) -> DataFrame:
    """(path, kind, names): the names of each kind in the order of their lines."""
    ordered = F.array_sort(F.collect_list(F.struct("start_line", "name")))
    return symbols.groupBy("path", "kind").agg(F.array_join(F.transform(ordered, lambda s: s["name"]), ",").alias("names"))


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """Points (point_id, path, line) with the innermost symbol around them: the one that begins last and ends first."""
    inside = points.join(symbols.select("symbol_id", "path", "start_line", "end_line"), "path").where("line BETWEEN start_line AND end_line")
    best = inside.groupBy("point_id", "path", "line").agg(F.max_by("symbol_id", F.struct("start_line", -F.col("end_line"), -F.col("symbol_id"))).alias("symbol_id"))
    return points.join(best.select("point_id", "symbol_id"), "point_id", "left")


def references(files: DataFrame, name: str, definitions: DataFrame, include_imports: bool = True) -> DataFrame:
    """(path, line, content) of lines that hold the name as a word, without its definitions (path, line). By name only: symbols of
    the same name are not told apart."""
    word = r"(?<![A-Za-z0-9_$])" + re.escape(name) + r"(?![A-Za-z0-9_$])"
    hits = files.where(F.col("content").contains(name)).select("path", F.posexplode(F.split("content", "\n", -1)).alias("at", "text")).where(F.col("text").rlike(word))
    lines = hits.select("path", (F.col("at") + 1).alias("line"), strip(F.col("text")).alias("content"))
    if not include_imports:
        lines = lines.where(~F.col("content").rlike(IMPORT_STARTS))
    return lines.join(definitions.select("path", "line"), ["path", "line"], "left_anti")


def reference_category(path: Column) -> Column:
    lower = F.lower(path)
    category = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, parts in REFERENCE_CATEGORIES:
        hit = F.lit(False)
        for part in parts:
            hit = hit | lower.contains(part)
        category = category.when(hit, label)
    for end in SOURCE_ENDS:
        category = category.when(lower.endswith(end), "source")
    return category.otherwise("other")


def dominant_style(symbols: DataFrame, group: list[str]) -> DataFrame:
    """(group, style, n): the most frequent naming style, ties by the earliest symbol; unknown styles do not count."""
    styled = symbols.select(*group, naming_style(F.col("name")).alias("style"), "start_line").where("style <> 'unknown'")
    counted = styled.groupBy(*group, "style").agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("first"))
    return counted.groupBy(*group).agg(F.max_by(F.struct("style", "n"), F.struct("n", -F.col("first"), F.col("style"))).alias("best")).select(*group, "best.style", "best.n")


def common_prefixes(symbols: DataFrame, group: list[str]) -> DataFrame:
    """(group, prefix, n) of name prefixes that at least two symbols share; a name may count for several."""
    hits = F.array_compact(F.array(*[F.when(F.col("name").startswith(p) & (F.length("name") > len(p)), F.lit(p)) for p in PREFIXES]))
    return symbols.select(*group, F.explode(hits).alias("prefix")).groupBy(*group, "prefix").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def common_tokens(symbols: DataFrame, group: list[str], pattern: str) -> DataFrame:
    """(group, token, n) of what a pattern finds in signatures at least twice: decorators, return types."""
    return symbols.select(*group, F.explode(F.regexp_extract_all("signature", F.lit(pattern), 1)).alias("token")).groupBy(*group, "token").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


DECORATOR_TOKEN = r"@(\w+)"
RETURN_TOKEN = r"->\s*(\w+(?:\[[\w,\s]+\])?)"


def visibility(name: Column, language: Column) -> Column:
    """By the language's rule: underscores in Python, capitals in Go, # in scripts, else internal for Java and public."""
    return (
        F.when(language == "python", F.when(name.startswith("__") & ~name.endswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public"))
        .when(language == "go", F.when(name.rlike("^[A-Z]"), "public").otherwise("private"))
        .when(language.isin("javascript", "typescript"), F.when(name.startswith("#"), "private").otherwise("public"))
        .when(language == "java", "internal")
        .otherwise("public")
    )


def replace_body(content: Column, start: Column, end: Column, body: Column) -> Column:
    """The text with the 1-based lines from start to end replaced."""
    lines = F.split(content, "\n", -1)
    return F.array_join(F.concat(F.slice(lines, 1, start - 1), F.array(body), F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))), "\n")


def insert_after(content: Column, line: Column, body: Column) -> Column:
    lines = F.split(content, "\n", -1)
    return F.array_join(F.concat(F.slice(lines, 1, line), F.array(body), F.slice(lines, line + 1, F.greatest(F.size(lines) - line, F.lit(0)))), "\n")


def insert_before(content: Column, line: Column, body: Column) -> Column:
    return insert_after(content, line - 1, body)


def rename(content: Column, old: str, new: str) -> Column:
    """Every occurrence of the name as a word; by name only."""
    return F.regexp_replace(content, r"(?<![A-Za-z0-9_$])" + re.escape(old) + r"(?![A-Za-z0-9_$])", new.replace("$", r"\$"))


def find_unique(found: DataFrame, name: str = "name") -> DataFrame:
    """The rows whose name no other row has; names that are ambiguous or null give none."""
    once = found.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(name)
    return found.join(once, name, "left_semi")


def definitions(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, path, start_line, kind) of every symbol that bears one of the names (name); by name alone, without a language server."""
    return symbols.join(names.select("name").distinct(), "name", "left_semi").select("name", "path", "start_line", "kind")
