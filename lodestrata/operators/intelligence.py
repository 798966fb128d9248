"""Recommendations, profiles, routing and summaries over learnt concepts and patterns (F7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import rules


def recommend(problems: DataFrame, frequencies: DataFrame, k: int = 5) -> DataFrame:
    """(problem_id, pattern_type, score, reasoning, rank) for problems (problem_id, description).

    A type scores with the share of its keywords that stand in the description, plus a hundredth of its learnt frequency
    (pattern_type, frequency), at most 0.3; the rules' order breaks ties. Keywords are found as parts of words too.
    The keyword rules are a projection; only types that hit are joined with the frequencies, which are one row per type.
    """
    text = F.lower(F.coalesce("description", F.lit("")))
    entries = [
        F.struct(
            F.lit(i).alias("place"), F.lit(kind).alias("pattern_type"), F.lit(reason).alias("reasoning"),
            (sum((text.contains(w).cast("int") for w in words), F.lit(0)) / float(len(words))).alias("share"),
        )
        for i, (kind, words, reason) in enumerate(rules.RECOMMENDATION_RULES)
    ]
    hits = problems.select("problem_id", F.inline(F.filter(F.array(*entries), lambda e: e["share"] > 0)))
    scored = hits.join(frequencies.select("pattern_type", "frequency"), "pattern_type", "left").withColumn(
        "score", F.round(F.col("share") + F.least(F.coalesce("frequency", F.lit(0)) / 100.0, F.lit(0.3)), 6)
    )
    rank = F.row_number().over(Window.partitionBy("problem_id").orderBy(F.col("score").desc(), "place"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("problem_id", "pattern_type", "score", "reasoning", "rank")


def learnt_frequencies(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pattern_type").agg(F.sum("frequency").alias("frequency"))


def predict_files(problem: str, concepts: DataFrame, directories: DataFrame, k: int = 10) -> DataFrame:
    """(target): files of concepts whose name holds a word of the problem, and directories its keywords point to; the first k."""
    words = [w for w in problem.lower().split() if w]
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower("name").contains(w)
    wanted = [d for keyword, names in rules.KEYWORD_DIRECTORIES if keyword in problem.lower() for d in names]
    named = concepts.where(hit).select(F.col("file_path").alias("target"))
    placed = directories.where(F.lower("directory").isin(*wanted) if wanted else F.lit(False)).select(F.col("directory").alias("target"))
    return named.unionByName(placed).where("target IS NOT NULL").distinct().orderBy("target").limit(k)


def suggest_patterns(text: Column) -> Column:
    """Sorted names of the patterns that the keywords in a text suggest, joined by commas."""
    lower = F.lower(text)
    parts = [F.when(lower.contains(keyword), F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>")) for keyword, names in rules.SUGGESTION_RULES]
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*parts))), ",")


#: Keywords, feature and kind of work; the first that fits counts.
ROUTES = (
    (("api", "endpoint", "route"), "api", "api_development"),
    (("test", "spec"), "testing", "testing"),
    (("model", "schema", "entity"), "models", "data_modeling"),
    (("service", "business"), "services", "service_development"),
    (("ui", "component", "view"), "ui", "ui_development"),
)


def route(problems: DataFrame) -> DataFrame:
    """(problem_id, feature, work_type): the first route whose keyword stands in the description, else general modification."""
    text = F.lower(F.coalesce("description", F.lit("")))
    feature = work = F.when(F.lit(False), F.lit(None).cast("string"))
    for words, name, kind in ROUTES:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        feature, work = feature.when(hit, name), work.when(hit, kind)
    return problems.select("problem_id", feature.otherwise("general").alias("feature"), work.otherwise("modification").alias("work_type"))


def route_files(paths: DataFrame, feature: str, k: int = 5) -> DataFrame:
    """The first k paths that hold the feature's name."""
    return paths.where(F.lower("path").contains(feature)).select("path").distinct().orderBy("path").limit(k)


#: Parts of pattern types and the preference or area they tell.
PREFERENCES = (
    (("singleton",), "singleton_pattern"), (("factory",), "factory_pattern"), (("dependency", "injection"), "dependency_injection"), (("decorator",), "decorator_pattern"),
    (("observer",), "observer_pattern"), (("strategy",), "strategy_pattern"),
)
EXPERTISE = ((("api",), "api_development"), (("test",), "testing"), (("singleton", "factory"), "design_patterns"), (("error",), "error_handling"))
#: Directory names that tell no feature.
PLAIN_DIRECTORIES = ("src", "lib", "pkg", "internal", "test", "tests")


def _contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | text.contains(part)
    return hit


def profile(patterns: DataFrame) -> DataFrame:
    """(aspect, value, n): structural preferences (the first that fits a pattern), areas of expertise (all), function naming."""
    kind = F.lower("pattern_type")
    preference = F.when(F.lit(False), F.lit(None).cast("string"))
    for parts, label in PREFERENCES:
        preference = preference.when(_contains_any(kind, parts), label)
    areas = [F.when(_contains_any(kind, parts), F.struct(F.lit("expertise").alias("aspect"), F.lit(label).alias("value"))) for parts, label in EXPERTISE]
    told = F.when(preference.isNotNull(), F.struct(F.lit("preference").alias("aspect"), preference.alias("value")))
    naming = F.when(kind.contains("camelcase"), F.struct(F.lit("functions").alias("aspect"), F.lit("camelCase").alias("value")))
    return patterns.select(F.inline(F.array_compact(F.array(told, naming, *areas)))).groupBy("aspect", "value").agg(F.count(F.lit(1)).alias("n"))


def recent_focus(patterns: DataFrame, k: int = 5) -> DataFrame:
    return patterns.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(k).select("id", "pattern_type", "created_at")


def feature_of(path: Column) -> Column:
    """The first directory below the repository that is not a plain one; null if there is none."""
    parts = F.split(path, "/")
    return F.try_element_at(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: ~p.isin(*PLAIN_DIRECTORIES)), F.lit(1))


def feature_map(concepts: DataFrame) -> DataFrame:
    """(feature, n_files, first_file) by the first telling directory of the concepts' files."""
    return concepts.select(feature_of(F.col("file_path")).alias("feature"), "file_path").where("feature IS NOT NULL").groupBy("feature").agg(
        F.count_distinct("file_path").alias("n_files"), F.min("file_path").alias("first_file")
    )


def concept_pairs(concepts: DataFrame) -> DataFrame:
    """(pairs): unordered pairs of concepts of one file, counted without forming them."""
    per_file = concepts.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("pairs"))


def pattern_prefixes(patterns: DataFrame) -> DataFrame:
    """(prefix, n): patterns by what stands before the first underscore of their type."""
    return patterns.groupBy(F.substring_index("pattern_type", "_", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def concept_density(concepts: DataFrame, files: DataFrame) -> DataFrame:
    """(n_concepts, n_lines, density): concepts per thousand lines; null without lines."""
    lines = files.agg(F.coalesce(F.sum(F.size(F.split("content", "\n", -1))), F.lit(0)).alias("n_lines"))
    return concepts.agg(F.count(F.lit(1)).alias("n_concepts")).crossJoin(lines).withColumn("density", F.when(F.col("n_lines") > 0, F.round(F.col("n_concepts") / F.col("n_lines") * 1000, 4)))
