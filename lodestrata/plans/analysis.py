"""Queries: code metrics, dependency graphs, extraction, symbols and intelligence."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.languages import detect_language
from lodestrata.operators import depgraph, extraction, intelligence, metrics, rules
from lodestrata.operators import symbols as nav
from lodestrata.plans.common import FILES, SYMBOLS, Query, count_matches, distinct, quoted, rule_values, source, symbols
from lodestrata.sources.tables import path_repository, table

#: Languages that are measured.
PROGRAMS = ("python", "typescript", "javascript", "go", "java")
PROBLEM = "create a shared cache service with an api endpoint and a test"


# metrics
def _measured(spark: SparkSession, d: str) -> DataFrame:
    return metrics.analyse(_programs(spark, d), F.col("language"))


def _programs(spark: SparkSession, d: str) -> DataFrame:
    return source(spark, d).where(F.col("language").isin(*PROGRAMS)).select("path", "language", "content")


def loc_metrics(spark: SparkSession, d: str) -> DataFrame:
    return source(spark, d).select("path", metrics.lines_of_code(F.col("content")).alias("l")).select("path", "l.total", "l.code", "l.comments", "l.blank", "l.logical")


def cyclomatic(spark: SparkSession, d: str) -> DataFrame:
    out = _programs(spark, d).select("path", metrics.cyclomatic(F.col("content"), F.col("language")).alias("cyclomatic"))
    return out.withColumn("level", metrics.level(F.col("cyclomatic"), metrics.CYCLOMATIC_LEVELS))


def cognitive(spark: SparkSession, d: str) -> DataFrame:
    v = _programs(spark, d).select("path", metrics.cognitive(F.col("content")).alias("cognitive"))
    return v.withColumn("level", metrics.level(F.col("cognitive"), metrics.COGNITIVE_LEVELS))


def halstead(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select("path", "halstead_n1", "halstead_n2", "halstead_t1", "halstead_t2", F.round("volume", 2).alias("volume"), F.round("difficulty", 2).alias("difficulty"))


def maintainability(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select("path", F.round("maintainability", 2).alias("maintainability"))


def file_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Per file: totals over its functions, cut out by their lines."""
    f = _functions(spark, d)
    return f.groupBy("path").agg(F.count(F.lit(1)).alias("n_functions"), F.sum("cyclomatic").alias("cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"), F.sum("cognitive").alias("cognitive"))


def _functions(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d).where("kind IN ('function', 'method', 'constructor')").select("symbol_id", "path", "name", "start_line", "end_line")
    texts = metrics.symbol_texts(s, _programs(spark, d)).withColumn("language", detect_language(F.col("path")))
    return texts.select("symbol_id", "path", "name", metrics.cyclomatic(F.col("content"), F.col("language")).alias("cyclomatic"), metrics.cognitive(F.col("content")).alias("cognitive"))


def complexity_hotspots(spark: SparkSession, d: str) -> DataFrame:
    m = _functions(spark, d).withColumns({"cyclomatic_level": metrics.level(F.col("cyclomatic"), metrics.CYCLOMATIC_LEVELS), "cognitive_level": metrics.level(F.col("cognitive"), metrics.COGNITIVE_LEVELS)})
    return metrics.hotspots(m, "moderate").select("symbol_id", "cyclomatic_level", "cognitive_level")


def refactorings(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d).where("kind IN ('function', 'method', 'constructor') AND language = 'python'").select("symbol_id", "path", "name", "start_line", "end_line")
    m = metrics.analyse(metrics.symbol_texts(s, source(spark, d).where("language = 'python'")).select("symbol_id", "name", "content"))
    return metrics.refactorings(m.withColumn("expected", F.lit("snake_case"))).select("symbol_id", "suggestion", "priority")


def health(spark: SparkSession, d: str) -> DataFrame:
    """Per repository, over its program files."""
    s = source(spark, d)
    m = _measured(spark, d).groupBy(path_repository(F.col("path")).alias("repo")).agg(F.avg("cyclomatic").alias("cyc"), F.avg("maintainability").alias("mi"))
    shape = s.groupBy(path_repository(F.col("path")).alias("repo")).agg(F.count_distinct("language").alias("n_languages"), F.count(F.lit(1)).alias("n_files"))
    score = metrics.health(F.col("cyc"), F.col("mi"), F.col("n_languages"), F.col("n_files"), F.lit(1))
    return m.join(shape, "repo").select("repo", score.alias("score"), (score >= 60).alias("healthy"))


# graph
def _imports(spark: SparkSession, d: str) -> DataFrame:
    return extraction.imports(source(spark, d))


def _edges(spark: SparkSession, d: str, include_stdlib: bool = False) -> DataFrame:
    return depgraph.edges_of(_imports(spark, d).withColumn("line", F.lit(None).cast("int")), include_stdlib=include_stdlib)


def import_lines(spark: SparkSession, d: str) -> DataFrame:
    return _imports(spark, d).groupBy("language", "kind", "is_relative", "relative_level", "is_stdlib").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("module").alias("n_modules"))


def import_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("source", "target", "edge_type", "is_external")


def degree_coupling(spark: SparkSession, d: str) -> DataFrame:
    return depgraph.degrees(_edges(spark, d))


def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d, include_stdlib=True)
    inside = F.lit(False)
    nodes = e.select(F.col("target").alias("node"), "is_external", "is_stdlib").unionByName(e.select(F.col("source").alias("node"), inside.alias("is_external"), inside.alias("is_stdlib")))
    nodes = nodes.groupBy("node").agg(F.min("is_external").alias("is_external"), F.min("is_stdlib").alias("is_stdlib"))
    return depgraph.metrics(e, nodes)


def most_coupled(spark: SparkSession, d: str) -> DataFrame:
    return depgraph.most_coupled(_edges(spark, d))


def mermaid(spark: SparkSession, d: str) -> DataFrame:
    return depgraph.mermaid_edges(_edges(spark, d)).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def _nation_graph(spark: SparkSession, d: str) -> DataFrame:
    """For each nation of customers the two nations whose suppliers deliver it most."""
    from pyspark.sql import Window

    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("source"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target"))
    q = li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").groupBy("source", "target").agg(F.sum("l_quantity").alias("q"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.col("q").desc(), "target"))
    return q.withColumn("r", rank).where("r <= 2").select(F.lpad(F.col("source").cast("string"), 2, "0").alias("source"), F.lpad(F.col("target").cast("string"), 2, "0").alias("target"))


def graph_closure(spark: SparkSession, d: str) -> DataFrame:
    return depgraph.closure(_nation_graph(spark, d))


def graph_depths(spark: SparkSession, d: str) -> DataFrame:
    return depgraph.depths(depgraph.closure(_nation_graph(spark, d)))


def graph_cycles(spark: SparkSession, d: str) -> DataFrame:
    return depgraph.cycles(_nation_graph(spark, d))


def import_closure(spark: SparkSession, d: str) -> DataFrame:
    return depgraph.closure(_edges(spark, d))


def import_depths(spark: SparkSession, d: str) -> DataFrame:
    return depgraph.depths(depgraph.closure(_edges(spark, d)))


def graph_documents(spark: SparkSession, d: str) -> DataFrame:
    """The import graph written as JSON documents and read again."""
    return depgraph.from_json(depgraph.to_json(_edges(spark, d).select("source", "target", "edge_type").distinct()))


def import_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The modules on import cycles of any length, by strongly connected component."""
    return depgraph.components(_edges(spark, d))


# extraction
def concept_extraction(spark: SparkSession, d: str) -> DataFrame:
    return extraction.concepts(source(spark, d))


def pattern_detection(spark: SparkSession, d: str) -> DataFrame:
    return extraction.detected_patterns(source(spark, d))


def naming_patterns(spark: SparkSession, d: str) -> DataFrame:
    return extraction.naming_patterns(symbols(spark, d))


def class_patterns(spark: SparkSession, d: str) -> DataFrame:
    return extraction.class_patterns(symbols(spark, d))


def function_patterns(spark: SparkSession, d: str) -> DataFrame:
    return extraction.function_patterns(symbols(spark, d))


def decorator_patterns(spark: SparkSession, d: str) -> DataFrame:
    return extraction.decorator_patterns(symbols(spark, d))


def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    return extraction.python_symbols(source(spark, d)).select("path", "name", "kind", "start_line", "end_line", "parent", "qualified_name", "visibility", "is_async", "error")


def python_imports(spark: SparkSession, d: str) -> DataFrame:
    return extraction.python_imports(source(spark, d))


def _two_backends(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = symbols(spark, d).select("symbol_id", "path", "name", "kind", "start_line", "backend")
    return s.where("backend = 'tree_sitter'"), s.where("backend <> 'tree_sitter'")


def merge_symbols(spark: SparkSession, d: str) -> DataFrame:
    primary, secondary = _two_backends(spark, d)
    return extraction.merge_symbols(primary, secondary).select("path", "name", "kind", "start_line").distinct()


def merge_patterns(spark: SparkSession, d: str) -> DataFrame:
    s = source(spark, d)
    found = extraction.detected_patterns(s).select("path", "pattern_type", "confidence", F.col("frequency").alias("n_evidence"), F.lit(10).alias("priority"))
    named = extraction.naming_patterns(symbols(spark, d)).select("path", "pattern_type", "confidence", F.col("frequency").alias("n_evidence"), F.lit(50).alias("priority"))
    return extraction.merge_patterns(found.unionByName(named))


def best_imports(spark: SparkSession, d: str) -> DataFrame:
    found = _imports(spark, d).select("path", "module", F.lit(10).alias("priority"))
    parsed = extraction.imports(source(spark, d).where("content LIKE '%class %'")).select("path", "module", F.lit(50).alias("priority"))
    return extraction.best_imports(found.unionByName(parsed)).groupBy("path", "priority").agg(F.count(F.lit(1)).alias("n"))


def merge_frameworks(spark: SparkSession, d: str) -> DataFrame:
    """Frameworks of scripts by two backends, of which typed sources go first."""
    from lodestrata.operators import files

    found = files.frameworks(source(spark, d)).withColumnRenamed("n_files", "n")
    scripts = found.withColumn("priority", F.when(F.col("language") == "typescript", 50).when(F.col("language") == "python", 20).otherwise(10))
    return extraction.merge_frameworks(scripts)


# symbols
def _named(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).select("symbol_id", "path", "name", "kind", "start_line", nav.name_parts(F.col("qualified_name"), F.col("parent"), F.col("name")).alias("parts"), F.lit(0).alias("overload"))


def find_symbol(spark: SparkSession, d: str) -> DataFrame:
    return nav.find(_named(spark, d), "cache", substring=True, include=("method", "function")).select("symbol_id", "path", "name")


def find_symbol_path(spark: SparkSession, d: str) -> DataFrame:
    """Methods by a path of two names: every class that has a method of the name size."""
    return nav.find(_named(spark, d), "size").where(F.size("parts") == 2).select("symbol_id", F.array_join("parts", "/").alias("name_path"))


def symbols_overview(spark: SparkSession, d: str) -> DataFrame:
    return nav.overview(symbols(spark, d))


def enclosing_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The innermost symbol around each symbol's second line, -1 if there is none."""
    s = symbols(spark, d)
    points = s.select(F.col("symbol_id").alias("point_id"), "path", (F.col("start_line") + 1).alias("line"))
    return nav.enclosing(points, s).select("point_id", F.coalesce("symbol_id", F.lit(-1)).alias("symbol_id"))


def symbol_references(spark: SparkSession, d: str) -> DataFrame:
    definitions = symbols(spark, d).where("name = 'size'").select("path", F.col("start_line").alias("line"))
    found = nav.references(source(spark, d), "size", definitions, include_imports=False)
    return found.withColumn("category", nav.reference_category(F.col("path")))


def symbol_bodies(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d).select("symbol_id", "path", "start_line", "end_line")
    return metrics.symbol_texts(s, source(spark, d)).select("symbol_id", F.sha2("content", 256).alias("body_hash"))


def sibling_style(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d)
    return nav.dominant_style(s, ["path", "kind"]).withColumn("confidence", F.round(F.least(F.col("n") / 5.0, F.lit(1.0)), 2))


def sibling_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return nav.common_prefixes(symbols(spark, d), ["path", "kind"])


def sibling_return_types(spark: SparkSession, d: str) -> DataFrame:
    return nav.common_tokens(symbols(spark, d), ["path", "kind"], nav.RETURN_TOKEN)


def symbol_edits(spark: SparkSession, d: str) -> DataFrame:
    """Replace, insert before and after, and rename, on each file's first symbol."""
    first = symbols(spark, d).groupBy("path").agg(F.min(F.struct("start_line", "end_line", "name", "symbol_id")).alias("s")).select("path", "s.*")
    f = source(spark, d).join(first, "path").where(F.size(F.split("content", "\n", -1)) >= F.col("end_line"))
    start, end, body = F.col("start_line"), F.col("end_line"), F.lit("// new")
    return f.select(
        "path", F.sha2(nav.replace_body(F.col("content"), start, end, body), 256).alias("replaced"), F.sha2(nav.insert_before(F.col("content"), start, body), 256).alias("before"),
        F.sha2(nav.insert_after(F.col("content"), end, body), 256).alias("after"), F.sha2(nav.rename(F.col("content"), "total", "sum"), 256).alias("renamed"),
    )


def symbol_visibility(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).groupBy("language", nav.visibility(F.col("name"), F.col("language")).alias("visibility")).agg(F.count(F.lit(1)).alias("n"))


# intelligence
def _patterns(spark: SparkSession, d: str) -> DataFrame:
    return distinct(spark, d, "developer_patterns", "pattern_type", "frequency", "created_at")


def _problems(spark: SparkSession, d: str) -> DataFrame:
    return distinct(spark, d, "project_decisions", "decision").select(F.col("id").alias("problem_id"), F.col("decision").alias("description"))


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    return intelligence.recommend(_problems(spark, d), intelligence.learnt_frequencies(_patterns(spark, d))).select("problem_id", "pattern_type", "score", "rank")


def predicted_files(spark: SparkSession, d: str) -> DataFrame:
    dirs = source(spark, d).select(F.split("path", "/")[1].alias("directory")).distinct()
    return intelligence.predict_files(PROBLEM, distinct(spark, d, "semantic_concepts", "name", "file_path"), dirs)


def suggested_patterns(spark: SparkSession, d: str) -> DataFrame:
    return _problems(spark, d).select("problem_id", intelligence.suggest_patterns(F.col("description")).alias("patterns"))


def routed_problems(spark: SparkSession, d: str) -> DataFrame:
    return intelligence.route(_problems(spark, d))


def routed_files(spark: SparkSession, d: str) -> DataFrame:
    return intelligence.route_files(source(spark, d), "services")


def developer_profile(spark: SparkSession, d: str) -> DataFrame:
    return intelligence.profile(_patterns(spark, d))


def recent_focus(spark: SparkSession, d: str) -> DataFrame:
    return intelligence.recent_focus(_patterns(spark, d))


def feature_map(spark: SparkSession, d: str) -> DataFrame:
    return intelligence.feature_map(table(spark, d, "semantic_concepts"))


def concept_pairs(spark: SparkSession, d: str) -> DataFrame:
    return intelligence.concept_pairs(distinct(spark, d, "semantic_concepts", "file_path"))


def pattern_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return intelligence.pattern_prefixes(_patterns(spark, d))


def concept_types(spark: SparkSession, d: str) -> DataFrame:
    return distinct(spark, d, "semantic_concepts", "concept_type", "confidence").groupBy("concept_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def concept_density(spark: SparkSession, d: str) -> DataFrame:
    return intelligence.concept_density(distinct(spark, d, "semantic_concepts"), source(spark, d))


def insights_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of concepts of a type whose name holds a word, each with the number of all that fit."""
    hit = distinct(spark, d, "semantic_concepts", "concept_type", "name").where((F.lower("concept_type") == "method") & F.lower("name").contains("cache")).select("id", "name")
    total = hit.agg(F.count(F.lit(1)).alias("total"))
    return hit.orderBy("name", "id").limit(10).crossJoin(total)


def queries() -> dict[str, Query]:
    mine = (
        loc_metrics, cyclomatic, cognitive, halstead, maintainability, file_complexity, complexity_hotspots, refactorings, import_lines, import_edges, degree_coupling, graph_metrics,
        most_coupled, graph_closure, graph_depths, graph_cycles, import_closure, import_depths, import_cycles, concept_extraction, pattern_detection, naming_patterns, class_patterns, function_patterns, decorator_patterns, graph_documents, python_symbols, python_imports, merge_symbols,
        merge_patterns, best_imports, merge_frameworks, find_symbol, find_symbol_path, symbols_overview, enclosing_symbols, symbol_references, symbol_bodies, sibling_style, sibling_prefixes,
        sibling_return_types, symbol_edits, symbol_visibility, recommendations, predicted_files, suggested_patterns, routed_problems, routed_files, developer_profile, recent_focus, feature_map,
        concept_pairs, pattern_prefixes, concept_types, concept_density, insights_page,
    )
    return {f.__name__: f for f in mine} | {"graph_mermaid": mermaid, "health_score": health}


# ---------------------------------------------------------------------------------------------------------------
# The same in SQL

_TRIM = r"regexp_replace(regexp_replace({0}, '^[\s\v\x{{85}}\p{{Z}}]+', ''), '[\s\v\x{{85}}\p{{Z}}]+$', '')"
_PY = f"py AS (SELECT path, content, language FROM files WHERE language IN ({', '.join(map(quoted, PROGRAMS))}))"
_LOC_STATE = "{'code': 0, 'comments': 0, 'blank': 0, 'logical': 0, 's': false, 'b': false, 't': ''}"


def _loc_sql(relation: str) -> str:
    t = "x.t"
    quote = f"(contains({t}, '\"\"\"') OR contains({t}, ''''''''))"
    one = f"(CASE WHEN contains({t}, '\"\"\"') THEN (length({t}) - length(replace({t}, '\"\"\"', ''))) / 3 ELSE (length({t}) - length(replace({t}, '''''''', ''))) / 3 END = 1)"
    kind = f"(CASE WHEN {t} = '' THEN 0 WHEN {quote} THEN 1 WHEN acc.s THEN 2 WHEN starts_with({t}, '#') OR starts_with({t}, '//') THEN 2 WHEN contains({t}, '/*') THEN 3 WHEN acc.b THEN 4 ELSE 5 END)"
    words = " OR ".join(f"contains({t}, '{w}')" for w in metrics.LOGICAL_WORDS)
    logical = f"({words} OR ends_with({t}, ';') OR ends_with({t}, ':') OR (contains({t}, '=') AND NOT (contains({t}, '==') OR contains({t}, '!=') OR contains({t}, '<=') OR contains({t}, '>='))))"
    step = f"""{{'code': acc.code + ({kind} = 5)::INT, 'comments': acc.comments + ({kind} IN (1, 2, 3, 4))::INT, 'blank': acc.blank + ({kind} = 0)::INT, 'logical': acc.logical + ({kind} = 5 AND {logical})::INT,
        's': CASE WHEN {kind} = 1 AND {one} THEN NOT acc.s ELSE acc.s END, 'b': CASE WHEN {kind} = 3 THEN NOT contains({t}, '*/') WHEN {kind} = 4 AND contains({t}, '*/') THEN false ELSE acc.b END, 't': ''}}"""
    rows = f"list_transform(string_split(content, chr(10)), lambda l: {{'code': 0, 'comments': 0, 'blank': 0, 'logical': 0, 's': false, 'b': false, 't': {_TRIM.format('l')}}})"
    return f"SELECT path, len(string_split(content, chr(10))) AS total, list_reduce(list_prepend({_LOC_STATE}, {rows}), lambda acc, x: {step}) AS r FROM {relation}"


def _word(column: str, *words: str) -> str:
    return f"len(regexp_extract_all({column}, '\\b(?:{'|'.join(words)})\\b'))"


def _literal(column: str, part: str) -> str:
    return f"((length({column}) - length(replace({column}, {quoted(part)}, ''))) // {len(part)})"


def _cyclomatic_sql(column: str, lang: str) -> str:
    keys = metrics.decision_set(lang)
    total = "1 + " + _word(column, *[k for k in keys if k not in metrics.LITERALS])
    total += "".join(" + " + _literal(column, k) for k in keys if k in metrics.LITERALS)
    if lang == "python":
        total += f" - len(regexp_extract_all({column}, '\\bif\\b[^\\n]*\\belse\\b')) // 2"
    return f"greatest({total}, 1)::INT"


def _level_sql(value: str, bounds: tuple[int, int, int]) -> str:
    return f"CASE WHEN {value} <= {bounds[0]} THEN 'low' WHEN {value} <= {bounds[1]} THEN 'moderate' WHEN {value} <= {bounds[2]} THEN 'high' ELSE 'very_high' END"


def _cyclomatic_all(column: str) -> str:
    return f"CASE language {' '.join(f'WHEN {quoted(lang)} THEN {_cyclomatic_sql(column, lang)}' for lang in PROGRAMS)} END"


def _cognitive_sql(column: str) -> str:
    t = "x.t"
    deeper = " OR ".join(f"contains({t}, '{w}:') OR contains({t}, '{w} ')" for w in metrics.NESTING)
    added = f"{_word(t, *metrics.NESTING)} * (1 + acc.d) + {_word(t, *metrics.STRUCTURAL)} + {_word(t, 'and', 'or')} + {_literal(t, '&&')} + {_literal(t, '||')}"
    skip = f"({t} = '' OR starts_with({t}, '#'))"
    step = f"""{{'v': CASE WHEN {skip} THEN acc.v ELSE acc.v + {added} END, 'd': CASE WHEN {skip} THEN acc.d WHEN {deeper} THEN acc.d + 1 WHEN {t} = 'pass' OR starts_with({t}, 'return') THEN greatest(acc.d - 1, 0) ELSE acc.d END, 't': ''}}"""
    rows = f"list_transform(string_split({column}, chr(10)), lambda l: {{'v': 0::BIGINT, 'd': 0::BIGINT, 't': {_TRIM.format('l')}}})"
    return f"(list_reduce(list_prepend({{'v': 0::BIGINT, 'd': 0::BIGINT, 't': ''}}, {rows}), lambda acc, x: {step})).v::INT"


def _halstead_sql() -> str:
    clean = "content"
    for p in metrics.CLEANING:
        clean = f"regexp_replace({clean}, {quoted(p)}, '', 'g')"
    ops = sorted(metrics.OPERATORS, key=len, reverse=True)
    steps, previous = [], "c0"
    for i, op in enumerate(ops):
        steps.append(f"h{i + 1} AS (SELECT * EXCLUDE (rest), {_literal('rest', op)} AS k{i}, replace(rest, {quoted(op)}, '{' ' * len(op)}') AS rest FROM {previous})")
        previous = f"h{i + 1}"
    listed = lambda lang: "[" + ", ".join(quoted(w) for w in (*metrics.decision_set(lang), *metrics.NO_OPERANDS)) + "]"
    stop = f"CASE language {' '.join(f'WHEN {quoted(lang)} THEN {listed(lang)}' for lang in PROGRAMS)} END"
    n1 = " + ".join(f"(k{i} > 0)::INT" for i in range(len(ops)))
    t1 = " + ".join(f"k{i}" for i in range(len(ops)))
    operands = f"list_concat(list_filter(list_filter(regexp_extract_all(clean, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*')), lambda w: NOT list_contains({stop}, w)), regexp_extract_all(clean, '\\b\\d+\\.?\\d*\\b'))"
    return f"""c AS (SELECT path, content, language, {clean} AS clean FROM py), c0 AS (SELECT path, content, language, clean, clean AS rest FROM c), {', '.join(steps)},
        hs AS (SELECT path, content, language, ({n1})::INT AS n1, len(list_distinct({operands}))::INT AS n2, ({t1})::INT AS t1, len({operands})::INT AS t2 FROM {previous}),
        hv AS (SELECT *, CASE WHEN n1 + n2 > 0 THEN (t1 + t2) * log2((n1 + n2)::DOUBLE) ELSE 0 END AS volume, CASE WHEN n2 > 0 THEN n1 / 2.0 * t2 / n2 ELSE 0 END AS difficulty FROM hs)"""


_MI = """CASE WHEN volume <= 0 OR code <= 0 THEN 100.0 ELSE greatest(0.0, least(100.0, (171 - 5.2 * ln(volume) - 0.23 * cyc - 16.2 * ln(code::DOUBLE)) * 100 / 171)) END"""
_ONLY_PYTHON = " AND s.language = 'python' AND f.language = 'python'"
_BODIES = f"""{FILES}, {SYMBOLS}, fb AS (SELECT symbol_id, s.path, name, f.language AS language, array_to_string(string_split(content, chr(10))[greatest(start_line, 1):end_line], chr(10)) AS body FROM syms s JOIN files f ON f.path = s.path
    WHERE kind IN ('function', 'method', 'constructor') AND f.language IN ({', '.join(map(quoted, PROGRAMS))}){_ONLY_PYTHON})"""

_MODULE = r"regexp_replace(translate(regexp_replace({0}, '([^/\\])\.[^./\\]*$', '\1'), '/\', '..'), '\.__init__$', '')"
_IMPORTS = """raw AS (
  SELECT path, language, kind, unnest(CASE WHEN files.language <> lang THEN [] WHEN inside IS NULL THEN regexp_extract_all(content, pattern, 1)
    ELSE flatten(list_transform(regexp_extract_all(content, pattern, 1), lambda g: regexp_extract_all(g, inside, 1))) END) AS raw FROM files, {rules}),
imp AS (SELECT *, language = 'python' AND NOT is_relative AND regexp_extract(module, '^[^.]*') IN ({standard}) AS is_stdlib FROM (SELECT path, language, CASE WHEN level > 0 THEN 'relative' ELSE kind END AS kind, level > 0 AS is_relative, level::INT AS relative_level,
    CASE WHEN script THEN translate(regexp_replace(raw, '^(?:\\.{{1,2}}/)+', ''), '/', '.') ELSE regexp_replace(raw, '^\\.+', '') END AS module FROM (
  SELECT *, language IN ('typescript', 'javascript') AND starts_with(raw, '.') AS script,
    CASE WHEN language = 'python' AND length(regexp_extract(raw, '^(\\.*)', 1)) > 0 THEN length(regexp_extract(raw, '^(\\.*)', 1))
         WHEN language IN ('typescript', 'javascript') AND starts_with(raw, '.') THEN 1 + len(regexp_extract_all(raw, '\\.\\./')) ELSE 0 END AS level FROM raw))),
every AS (SELECT source, CASE WHEN NOT is_relative THEN module WHEN relative_level > len(parts) THEN coalesce(nullif(module, ''), source)
      ELSE array_to_string(CASE WHEN coalesce(module, '') <> '' THEN list_append(parts[1:greatest(len(parts) - relative_level, 0)], module) ELSE parts[1:greatest(len(parts) - relative_level, 0)] END, '.') END AS target,
    CASE WHEN kind IN ('from_import', 'relative', 'star_import', 'type_only', 'dynamic') THEN kind ELSE 'direct' END AS edge_type, NOT is_relative AS is_external, is_stdlib
  FROM (SELECT *, {module} AS source, string_split({module}, '.') AS parts FROM imp)),
edges AS (SELECT * FROM every WHERE NOT is_stdlib),
pairs AS (SELECT DISTINCT source, target FROM edges),
deg AS (SELECT node, sum(o)::BIGINT AS n_imports, sum(i)::BIGINT AS n_imported_by, (sum(o) + sum(i))::BIGINT AS coupling FROM (SELECT source AS node, 1 AS o, 0 AS i FROM pairs UNION ALL SELECT target, 0, 1 FROM pairs) GROUP BY node)""".format(
    rules=rule_values(list(extraction.IMPORT_RULES), "lang, kind, pattern, inside"), standard=", ".join(map(quoted, sorted(sys.stdlib_module_names))), module=_MODULE.format("path")
)
_NATIONS = """ng AS (SELECT lpad(source::VARCHAR, 2, '0') AS source, lpad(target::VARCHAR, 2, '0') AS target FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY q DESC, target) AS r FROM (
    SELECT c_nationkey AS source, s_nationkey AS target, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)) WHERE r <= 2)"""
_CLOSURE = f"""WITH RECURSIVE {_NATIONS}, cl AS (SELECT source, target, 1 AS distance FROM ng UNION SELECT cl.source, ng.target, distance + 1 FROM cl JOIN ng ON ng.source = cl.target WHERE distance < 30),
    best AS (SELECT source, target, min(distance)::INT AS distance FROM cl GROUP BY 1, 2)"""


def _detect_sql(min_confidence: float) -> str:
    return f"""det AS (SELECT path, pattern_type, max(CASE WHEN n > 0 THEN confidence ELSE 0 END)::DOUBLE AS confidence, sum(n)::BIGINT AS frequency FROM (
        SELECT path, pattern_type, confidence, len(regexp_extract_all(content, pattern)) AS n FROM files, {rule_values(list(rules.DETECTION_RULES), 'pattern_type, pattern, confidence')})
        GROUP BY 1, 2 HAVING max(CASE WHEN n > 0 THEN confidence ELSE 0 END) >= {min_confidence})"""


def _segmented_sql() -> str:
    from lodestrata.functions.naming import SEGMENTED

    camel, pascal, snake, screaming = (f"regexp_matches(name, {quoted(p)})" for _, p in SEGMENTED)
    a, b, c, e = (label for label, _ in SEGMENTED)
    return f"""nam AS (SELECT path, pattern_type, count(*) AS frequency, round(least(0.5 + count(*) * 0.1, 0.95), 4)::DOUBLE AS confidence FROM (SELECT path,
        CASE WHEN kind IN ('class', 'interface', 'struct', 'enum', 'trait') THEN CASE WHEN {pascal} THEN '{b}' END WHEN kind IN ('function', 'method') THEN CASE WHEN {camel} THEN '{a}' WHEN {snake} THEN '{c}' END
             WHEN kind IN ('constant', 'variable') THEN CASE WHEN {screaming} THEN '{e}' WHEN {snake} THEN '{c}' END END AS pattern_type FROM syms) WHERE pattern_type IS NOT NULL GROUP BY 1, 2)"""


def _style_sql() -> str:
    from lodestrata.plans.paths import _STYLE

    return _STYLE


def _class_sql() -> str:
    lower = "lower(name)"
    any_word = lambda words: f"regexp_matches({lower}, '{'|'.join(words)}')"
    w = lambda cond, weight: f"(CASE WHEN coalesce({cond}, false) THEN {weight} ELSE 0 END)"
    evidence = {
        "singleton": [("has_instance", 0.3), ("has_getter", 0.4), ("has_new", 0.3), ("contains(lo, 'singleton')", 0.2)],
        "factory": [("creates", 0.4), ("makes", 0.3), ("contains(lo, 'factory')", 0.4)],
        "repository": [("n_crud >= 2", 0.4), ("contains(lo, 'repo')", 0.5), ("contains(lo, 'dao')", 0.4)],
        "service": [("contains(lo, 'service')", 0.6), ("serves", 0.3)],
        "context_manager": [("enters", 0.5), ("exits", 0.5)],
        "dataclass": [("is_data", 1.0)],
        "god_class": [(f"n_methods > {extraction.GOD_METHODS}", 0.4), (f"n_lines > {extraction.GOD_LINES}", 0.4)],
    }
    parts = " UNION ALL ".join(f"SELECT symbol_id, '{k}' AS pattern, round(least({' + '.join(w(c, x) for c, x in rows)}, 1.0), 4)::DOUBLE AS confidence FROM j" for k, rows in evidence.items())
    return f"""WITH {SYMBOLS}, m AS (SELECT path, trim(parent) AS owner, count(*) AS n_methods, bool_or({lower} IN ('instance', '_instance')) AS has_instance, bool_or({lower} IN ('get_instance', 'getinstance')) AS has_getter,
        bool_or(name = '__new__') AS has_new, bool_or(contains({lower}, 'create')) AS creates, bool_or(contains({lower}, 'make') OR contains({lower}, 'build')) AS makes, count(*) FILTER (WHERE {any_word(extraction.CRUD_WORDS)}) AS n_crud,
        bool_or({any_word(extraction.SERVICE_WORDS)}) AS serves, bool_or(name IN ('__enter__', '__aenter__')) AS enters, bool_or(name IN ('__exit__', '__aexit__')) AS exits
        FROM syms WHERE kind IN ('method', 'constructor', 'function') AND parent IS NOT NULL GROUP BY 1, 2),
        j AS (SELECT symbol_id, lower(name) AS lo, end_line - start_line + 1 AS n_lines, len(list_filter(coalesce(decorators, []), lambda d: contains(lower(d), 'dataclass'))) > 0 AS is_data, m.* FROM syms s LEFT JOIN m ON m.path = s.path AND m.owner = s.name WHERE kind IN ('class', 'struct'))
        SELECT * FROM ({parts}) WHERE confidence >= 0.5"""


_WORDCHARS = "A-Za-z0-9_$"


def _concepts_sql() -> str:
    return f"""SELECT path, name, concept_type, confidence::DOUBLE AS confidence, count(*) AS n FROM (
        SELECT path, unnest(regexp_extract_all(content, {quoted(extraction.CLASS_RULE)}, 1)) AS name, 'class' AS concept_type, 0.9 AS confidence FROM files UNION ALL
        SELECT path, f.n AS name, CASE WHEN f.l = '' THEN 'function' ELSE 'method' END, 0.85 FROM (SELECT path, unnest(list_zip(regexp_extract_all(content, {quoted(extraction.FUNCTION_RULE)}, 1), regexp_extract_all(content, {quoted(extraction.FUNCTION_RULE)}, 2))) AS z FROM files) t, LATERAL (SELECT z[1] AS l, z[2] AS n) f UNION ALL
        SELECT path, unnest(regexp_extract_all(content, {quoted(extraction.CONSTANT_RULE)}, 1)), 'constant', 0.8 FROM files) GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    from lodestrata.functions.naming import PREFIXES
    from lodestrata.plans.paths import _STYLE

    shares = " UNION ALL ".join(
        f"SELECT problem_id, {i} AS place, '{kind}' AS pattern_type, ({' + '.join(f'contains(t, {quoted(w)})::INT' for w in words)}) / {len(words)}.0 AS share FROM p" for i, (kind, words, _) in enumerate(rules.RECOMMENDATION_RULES)
    )
    problems = "p AS (SELECT DISTINCT id AS problem_id, lower(coalesce(decision, '')) AS t FROM project_decisions)"
    routes = lambda k: " ".join(f"WHEN {' OR '.join(f'contains(t, {quoted(w)})' for w in r[0])} THEN '{r[k]}'" for r in intelligence.ROUTES)
    words = PROBLEM.split()
    wanted = [n for keyword, names in rules.KEYWORD_DIRECTORIES if keyword in PROBLEM for n in names]
    suggestion = "list_concat(" + ", ".join(f"CASE WHEN contains(t, '{k}') THEN [{', '.join(map(quoted, names))}] ELSE [] END" for k, names in rules.SUGGESTION_RULES) + ")"
    for_any = lambda parts: " OR ".join(f"contains(k, '{p}')" for p in parts)
    preferences = "CASE " + " ".join(f"WHEN {for_any(parts)} THEN '{label}'" for parts, label in intelligence.PREFERENCES) + " END"
    expertise = " UNION ALL ".join(f"SELECT 'expertise', '{label}' FROM k WHERE {for_any(parts)}" for parts, label in intelligence.EXPERTISE)
    plain = ", ".join(map(quoted, intelligence.PLAIN_DIRECTORIES))
    categories = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(path), {quoted(x)})' for x in parts)} THEN '{label}'" for label, parts in nav.REFERENCE_CATEGORIES) + " " + " ".join(f"WHEN ends_with(lower(path), '{e}') THEN 'source'" for e in nav.SOURCE_ENDS) + " ELSE 'other' END"
    prefixes = " UNION ALL ".join(f"SELECT path, kind, {quoted(p)} AS prefix FROM syms WHERE starts_with(name, {quoted(p)}) AND length(name) > {len(p)}" for p in PREFIXES)
    size_word = r"'(^|[^A-Za-z0-9_$])size([^A-Za-z0-9_$]|$)'"
    c = "SELECT DISTINCT * FROM semantic_concepts"
    cyc = f"SELECT path, {_cyclomatic_all('content')} AS cyclomatic FROM py"
    measured = f"""{FILES}, {_PY}, {_halstead_sql()}, lo AS ({_loc_sql('py')}), mi AS (SELECT hv.path, hv.volume, hv.difficulty, r.code AS code, {_cyclomatic_all('hv.content')} AS cyc FROM hv JOIN lo ON lo.path = hv.path)"""
    functions = f"""{_BODIES.replace(_ONLY_PYTHON, '')}, fx AS (SELECT symbol_id, path, name, {_cyclomatic_all('body')} AS cyclomatic, {_cognitive_sql('body')} AS cognitive FROM fb)"""
    rank = lambda l: f"CASE {l} WHEN 'low' THEN 0 WHEN 'moderate' THEN 1 WHEN 'very_high' THEN 3 ELSE 2 END"
    return {
        "loc_metrics": f"WITH {FILES}, x AS ({_loc_sql('files')}) SELECT path, total::INT AS total, r.code AS code, r.comments AS comments, r.blank AS blank, r.logical AS logical FROM x",
        "cyclomatic": f"WITH {FILES}, {_PY}, x AS ({cyc}) SELECT *, {_level_sql('cyclomatic', metrics.CYCLOMATIC_LEVELS)} AS level FROM x",
        "cognitive": f"WITH {FILES}, {_PY}, x AS (SELECT path, {_cognitive_sql('content')} AS cognitive FROM py) SELECT *, {_level_sql('cognitive', metrics.COGNITIVE_LEVELS)} AS level FROM x",
        "halstead": f"WITH {FILES}, {_PY}, {_halstead_sql()} SELECT path, n1 AS halstead_n1, n2 AS halstead_n2, t1 AS halstead_t1, t2 AS halstead_t2, round(round(volume, 4)::DECIMAL(18, 4), 2)::DOUBLE AS volume, round(round(difficulty, 4)::DECIMAL(18, 4), 2)::DOUBLE AS difficulty FROM hv",
        "maintainability": f"WITH {measured} SELECT path, round(round({_MI}, 4)::DECIMAL(18, 4), 2)::DOUBLE AS maintainability FROM mi",
        "file_complexity": f"WITH {functions} SELECT path, count(*) AS n_functions, sum(cyclomatic)::BIGINT AS cyclomatic, max(cyclomatic) AS max_cyclomatic, sum(cognitive)::BIGINT AS cognitive FROM fx GROUP BY path",
        "complexity_hotspots": f"""WITH {functions}, l AS (SELECT symbol_id, {_level_sql('cyclomatic', metrics.CYCLOMATIC_LEVELS)} AS cyclomatic_level, {_level_sql('cognitive', metrics.COGNITIVE_LEVELS)} AS cognitive_level FROM fx)
            SELECT * FROM l WHERE {rank('cyclomatic_level')} >= 1 OR {rank('cognitive_level')} >= 1""",
        "refactorings": f"""WITH {_BODIES}, py AS (SELECT symbol_id::VARCHAR AS path, body AS content, language FROM fb), {_halstead_sql()}, lo AS ({_loc_sql('py')}),
            mi0 AS (SELECT hv.path, hv.volume, r.code AS code, {_cyclomatic_sql('hv.content', 'python')} AS cyc, {_cognitive_sql('hv.content')} AS cog FROM hv JOIN lo ON lo.path = hv.path),
            mi AS (SELECT m.path AS symbol_id, fb.name, cyc, cog, round({_MI}, 4) AS mi FROM mi0 m JOIN fb ON fb.symbol_id::VARCHAR = m.path)
            SELECT symbol_id::BIGINT AS symbol_id, CASE WHEN cyc > 20 OR cog > 25 THEN 'extract_method' ELSE 'reduce_complexity' END AS suggestion,
                   CASE WHEN cyc > 20 OR cog > 25 THEN CASE WHEN cyc > 30 THEN 'critical' ELSE 'high' END WHEN cyc > 20 AND cyc <= 50 THEN 'high' ELSE 'medium' END AS priority FROM mi WHERE cyc > 10 OR cog > 15
            UNION ALL SELECT symbol_id::BIGINT, 'improve_maintainability', CASE WHEN mi < 25 THEN 'high' ELSE 'medium' END FROM mi WHERE mi < 40
            UNION ALL SELECT symbol_id::BIGINT, 'rename', 'low' FROM (SELECT symbol_id, {_STYLE} AS style FROM mi) WHERE style NOT IN ('snake_case', 'unknown', 'flat_case')""",
        "health_score": f"""WITH {measured}, m AS (SELECT string_split(path, '/')[1] AS repo, avg(cyc) AS cyc, avg(round({_MI}, 4)) AS mi FROM mi GROUP BY 1),
            s AS (SELECT string_split(path, '/')[1] AS repo, count(DISTINCT language) AS n_languages FROM files GROUP BY 1),
            h AS (SELECT repo, greatest(100 - CASE WHEN cyc > 30 THEN 20 WHEN cyc > 15 THEN 10 ELSE 0 END - CASE WHEN mi < 50 THEN 15 ELSE 0 END - CASE WHEN n_languages > 3 THEN 5 ELSE 0 END, 0)::INT AS score FROM m JOIN s USING (repo))
            SELECT repo, score, score >= 60 AS healthy FROM h""",
        "symbol_edits": f"""WITH {FILES}, f1 AS (SELECT file_path AS path, min((start_line, end_line, name, symbol_id)) AS s FROM symbols GROUP BY 1),
            x AS (SELECT f.path, content, string_split(content, chr(10)) AS l, s[1] AS a, s[2] AS b FROM files f JOIN f1 ON f1.path = f.path WHERE len(string_split(content, chr(10))) >= s[2])
            SELECT path, sha256(array_to_string(list_concat(l[1:a - 1], ['// new'], l[b + 1:]), chr(10))) AS replaced, sha256(array_to_string(list_concat(l[1:a - 1], ['// new'], l[a:]), chr(10))) AS before,
                   sha256(array_to_string(list_concat(l[1:b], ['// new'], l[b + 1:]), chr(10))) AS after,
                   sha256(regexp_replace(regexp_replace(content, '(^|[^{_WORDCHARS}])total([^{_WORDCHARS}]|$)', '\\1sum\\2', 'g'), '(^|[^{_WORDCHARS}])total([^{_WORDCHARS}]|$)', '\\1sum\\2', 'g')) AS renamed FROM x""",
        "import_lines": f"WITH {FILES}, {_IMPORTS} SELECT language, kind, is_relative, relative_level, is_stdlib, count(*) AS n, count(DISTINCT module) AS n_modules FROM imp GROUP BY ALL",
        "import_edges": f"WITH {FILES}, {_IMPORTS} SELECT source, target, edge_type, is_external FROM edges",
        "degree_coupling": f"WITH {FILES}, {_IMPORTS} SELECT * FROM deg",
        "graph_metrics": f"""WITH {FILES}, {_IMPORTS}, nodes AS (SELECT node, bool_and(is_external) AS ext, bool_and(std) AS std FROM (SELECT target AS node, is_external, is_stdlib AS std FROM every UNION ALL SELECT source, false, false FROM every) GROUP BY node),
            allp AS (SELECT DISTINCT source, target FROM every), alld AS (SELECT node, sum(o) AS n_imports, sum(i) AS n_imported_by FROM (SELECT source AS node, 1 AS o, 0 AS i FROM allp UNION ALL SELECT target, 0, 1 FROM allp) GROUP BY node),
            t AS (SELECT count(*) FILTER (WHERE NOT ext) AS m, count(*) FILTER (WHERE ext) AS e, count(*) FILTER (WHERE std) AS sd, coalesce(sum(n_imports) FILTER (WHERE NOT ext), 0) AS o, coalesce(sum(n_imported_by) FILTER (WHERE NOT ext), 0) AS i FROM nodes LEFT JOIN alld USING (node))
            SELECT m AS total_modules, (SELECT count(*) FROM every) AS total_edges, e AS external_dependencies, sd AS stdlib_dependencies, round(o / m, 6)::DOUBLE AS avg_imports, round(i / m, 6)::DOUBLE AS avg_imported_by, round(o / (o + i), 6)::DOUBLE AS instability FROM t""",
        "most_coupled": f"WITH {FILES}, {_IMPORTS} SELECT * FROM deg ORDER BY coupling DESC, node LIMIT 20",
        "graph_mermaid": f"""WITH {FILES}, {_IMPORTS}, top AS (SELECT node FROM deg ORDER BY coupling DESC, node LIMIT 20)
            SELECT '    ' || replace(source, '.', '_') || ' --> ' || replace(target, '.', '_') AS line, count(*) AS n FROM edges WHERE source IN (FROM top) AND target IN (FROM top) GROUP BY 1""",
        "graph_closure": f"{_CLOSURE} SELECT source, target, distance FROM best",
        "graph_depths": f"{_CLOSURE} SELECT source AS node, max(distance)::INT AS depth FROM best GROUP BY 1",
        "graph_cycles": f"""{_CLOSURE}, st AS (SELECT b.source, b.target, min(g.target) AS nxt FROM best b JOIN ng g ON g.source = b.source LEFT JOIN best r ON r.source = g.target AND r.target = b.target
              WHERE (g.target = b.target AND b.distance = 1) OR (b.distance > 1 AND r.distance = b.distance - 1) GROUP BY 1, 2),
            walk AS (SELECT source AS u, [source] AS path, target AS here FROM ng UNION ALL SELECT u, list_append(path, here), nxt FROM walk JOIN st ON st.source = here AND st.target = u WHERE here <> u),
            c AS (SELECT DISTINCT list_concat(path[list_position(path, list_min(path)):], path[:list_position(path, list_min(path)) - 1]) AS path FROM walk WHERE here = u)
            SELECT array_to_string(list_append(path, path[1]), ' -> ') AS cycle, len(path)::INT AS length, CASE WHEN len(path) <= 2 THEN 'error' ELSE 'warning' END AS severity FROM c""",
        "concept_extraction": f"WITH {FILES} {_concepts_sql()}",
        "pattern_detection": f"WITH {FILES}, {_detect_sql(0.5)} SELECT * FROM det",
        "naming_patterns": f"WITH {SYMBOLS}, {_segmented_sql()} SELECT path, pattern_type, frequency, confidence FROM nam",
        "class_patterns": _class_sql(),
        "function_patterns": f"""WITH {SYMBOLS}, f AS (SELECT symbol_id, is_async, end_line - start_line + 1 AS n FROM syms WHERE kind IN ('function', 'method', 'constructor'))
            SELECT symbol_id, 'async_pattern' AS pattern, 0.9::DOUBLE AS confidence FROM f WHERE is_async UNION ALL SELECT symbol_id, 'long_method', CASE WHEN n >= 100 THEN 0.9 ELSE 0.7 END FROM f WHERE n > 50""",
        "decorator_patterns": f"""WITH {SYMBOLS}, x AS (SELECT symbol_id, regexp_replace(unnest(decorators), '^@', '') AS d FROM syms)
            SELECT DISTINCT symbol_id, CASE WHEN d = 'property' THEN 'property_pattern' ELSE 'dataclass' END AS pattern, 1.0::DOUBLE AS confidence FROM x WHERE d IN ('property', 'dataclass', 'dataclasses.dataclass')""",
        "graph_documents": f"WITH {FILES}, {_IMPORTS} SELECT DISTINCT source, target, edge_type FROM edges",
        "merge_symbols": f"""WITH {SYMBOLS}, a AS (SELECT path, name, kind, start_line FROM syms WHERE backend = 'tree_sitter'), b AS (SELECT path, name, kind, start_line, row_number() OVER (PARTITION BY path, name ORDER BY start_line) AS rn FROM syms s
            WHERE backend <> 'tree_sitter' AND kind = 'constant' AND NOT EXISTS (SELECT 1 FROM a WHERE a.path = s.path AND a.name = s.name)) SELECT DISTINCT path, name, kind, start_line FROM (SELECT * FROM a UNION ALL SELECT path, name, kind, start_line FROM b WHERE rn = 1)""",
        "merge_patterns": f"""WITH {FILES}, {SYMBOLS}, {_detect_sql(0.5)}, {_segmented_sql()}, u AS (SELECT path, pattern_type, confidence, frequency AS n_evidence, 10 AS priority FROM det UNION ALL SELECT path, pattern_type, confidence, frequency, 50 FROM nam)
            SELECT path, pattern_type, confidence, n_evidence, priority FROM (SELECT *, row_number() OVER (PARTITION BY path, pattern_type ORDER BY confidence DESC, n_evidence DESC, priority DESC) AS rn FROM u) WHERE rn = 1""",
        "best_imports": f"""WITH {FILES}, {_IMPORTS}, u AS (SELECT i.path, module, 10 AS priority FROM imp i UNION ALL SELECT i.path, module, 50 FROM imp i JOIN files f ON f.path = i.path WHERE contains(f.content, 'class '))
            SELECT path, priority, count(*) AS n FROM u WHERE (path, priority) IN (SELECT (path, max(priority)) FROM u GROUP BY path) GROUP BY 1, 2""",
        "merge_frameworks": f"""WITH {FILES}, u AS (SELECT framework, v.language, count(DISTINCT path) AS n, CASE v.language WHEN 'typescript' THEN 50 WHEN 'python' THEN 20 ELSE 10 END AS priority
              FROM files f, {rule_values(list(rules.FRAMEWORK_RULES), 'language, framework, pattern')} WHERE v.language = f.language AND regexp_matches(content, pattern) GROUP BY 1, 2)
            SELECT framework, arg_max(language, priority) AS language, arg_max(n, priority) AS n, max(priority) AS priority FROM u GROUP BY 1""",
        "find_symbol": f"WITH {SYMBOLS} SELECT symbol_id, path, name FROM syms WHERE kind IN ('method', 'function') AND contains(lower(CASE WHEN qualified_name <> '' THEN string_split(qualified_name, '.')[-1] ELSE name END), 'cache')",
        "find_symbol_path": f"""WITH {SYMBOLS}, p AS (SELECT symbol_id, CASE WHEN qualified_name <> '' THEN string_split(qualified_name, '.') ELSE list_filter([nullif(trim(parent), ''), name], lambda x: x IS NOT NULL) END AS parts FROM syms)
            SELECT symbol_id, array_to_string(parts, '/') AS name_path FROM p WHERE len(parts) = 2 AND parts[-1] = 'size'""",
        "symbols_overview": f"WITH {SYMBOLS} SELECT path, kind, string_agg(name, ',' ORDER BY start_line, name) AS names FROM syms GROUP BY 1, 2",
        "enclosing_symbols": f"""WITH {SYMBOLS} SELECT point_id, coalesce(symbol_id, -1) AS symbol_id FROM (SELECT a.symbol_id AS point_id, b.symbol_id, row_number() OVER (PARTITION BY a.symbol_id ORDER BY b.start_line DESC, b.end_line, b.symbol_id) AS rn
            FROM syms a LEFT JOIN syms b ON b.path = a.path AND a.start_line + 1 BETWEEN b.start_line AND b.end_line) WHERE rn = 1""",
        "symbol_references": f"""WITH {FILES}, l AS (SELECT path, x.t AS text, x.i AS line FROM (SELECT path, unnest(list_transform(string_split(content, chr(10)), lambda t, i: {{'t': t, 'i': i}})) AS x FROM files WHERE contains(content, 'size'))),
            h AS (SELECT path, line::INT AS line, {_TRIM.format('text')} AS content FROM l WHERE regexp_matches(text, {size_word}))
            SELECT path, line, content, {categories} AS category FROM h WHERE NOT regexp_matches(content, {quoted(nav.IMPORT_STARTS)}) AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.name = 'size' AND s.file_path = h.path AND s.start_line = h.line)""",
        "symbol_bodies": f"WITH {FILES}, {SYMBOLS} SELECT symbol_id, sha256(coalesce(array_to_string(string_split(content, chr(10))[greatest(start_line, 1):end_line], chr(10)), '')) AS body_hash FROM syms s JOIN files f ON f.path = s.path",
        "sibling_style": f"""WITH {SYMBOLS}, st AS (SELECT path, kind, {_STYLE} AS style, count(*) AS n, min(start_line) AS first FROM syms GROUP BY 1, 2, 3)
            SELECT path, kind, style, n, round(least(n / 5.0, 1.0), 2)::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY path, kind ORDER BY n DESC, first, style DESC) AS rn FROM st WHERE style <> 'unknown') WHERE rn = 1""",
        "sibling_prefixes": f"WITH {SYMBOLS}, x AS ({prefixes}) SELECT path, kind, prefix, count(*) AS n FROM x GROUP BY 1, 2, 3 HAVING count(*) >= 2",
        "sibling_return_types": f"WITH {SYMBOLS}, x AS (SELECT path, kind, unnest(regexp_extract_all(signature, {quoted(nav.RETURN_TOKEN)}, 1)) AS token FROM syms) SELECT path, kind, token, count(*) AS n FROM x GROUP BY 1, 2, 3 HAVING count(*) >= 2",
        "symbol_visibility": f"""WITH {SYMBOLS} SELECT language, CASE language WHEN 'python' THEN CASE WHEN starts_with(name, '__') AND NOT ends_with(name, '__') THEN 'private' WHEN starts_with(name, '_') THEN 'protected' ELSE 'public' END
            WHEN 'go' THEN CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'public' ELSE 'private' END WHEN 'java' THEN 'internal' ELSE CASE WHEN starts_with(name, '#') THEN 'private' ELSE 'public' END END AS visibility, count(*) AS n FROM syms GROUP BY 1, 2""",
        "recommendations": f"""WITH {problems}, h AS ({shares}), f AS (SELECT pattern_type, sum(frequency) AS frequency FROM (SELECT DISTINCT * FROM developer_patterns) GROUP BY 1),
            s AS (SELECT problem_id, place, h.pattern_type, round(share + least(coalesce(frequency, 0) / 100.0, 0.3), 6)::DOUBLE AS score FROM h LEFT JOIN f USING (pattern_type) WHERE share > 0)
            SELECT problem_id, pattern_type, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, place) AS rank FROM s) WHERE rank <= 5""",
        "predicted_files": f"""WITH {FILES} SELECT DISTINCT target FROM (SELECT file_path AS target FROM semantic_concepts WHERE {' OR '.join(f"contains(lower(name), '{w}')" for w in words)}
            UNION ALL SELECT string_split(path, '/')[2] FROM files WHERE lower(string_split(path, '/')[2]) IN ({', '.join(map(quoted, wanted))})) WHERE target IS NOT NULL ORDER BY target LIMIT 10""",
        "suggested_patterns": f"WITH {problems} SELECT problem_id, coalesce(array_to_string(list_sort(list_distinct({suggestion})), ','), '') AS patterns FROM p",
        "routed_problems": f"WITH {problems} SELECT problem_id, CASE {routes(1)} ELSE 'general' END AS feature, CASE {routes(2)} ELSE 'modification' END AS work_type FROM p",
        "routed_files": f"WITH {FILES} SELECT path FROM files WHERE contains(lower(path), 'services') ORDER BY path LIMIT 5",
        "developer_profile": f"""WITH k AS (SELECT lower(pattern_type) AS k FROM (SELECT DISTINCT * FROM developer_patterns)), x(aspect, value) AS (SELECT 'preference', {preferences} FROM k UNION ALL SELECT 'functions', 'camelCase' FROM k WHERE contains(k, 'camelcase') UNION ALL {expertise})
            SELECT aspect, value, count(*) AS n FROM x WHERE value IS NOT NULL GROUP BY 1, 2""",
        "recent_focus": "SELECT id, pattern_type, created_at FROM (SELECT DISTINCT * FROM developer_patterns) ORDER BY created_at DESC, id DESC LIMIT 5",
        "feature_map": f"""WITH x AS (SELECT list_filter(string_split(file_path, '/')[2:len(string_split(file_path, '/')) - 1], lambda p: p NOT IN ({plain}))[1] AS feature, file_path FROM ({c}))
            SELECT feature, count(DISTINCT file_path) AS n_files, min(file_path) AS first_file FROM x WHERE feature IS NOT NULL GROUP BY 1""",
        "concept_pairs": f"SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT AS pairs FROM (SELECT count(*) AS n FROM ({c}) GROUP BY file_path)",
        "pattern_prefixes": "SELECT string_split(pattern_type, '_')[1] AS prefix, count(*) AS n FROM (SELECT DISTINCT * FROM developer_patterns) GROUP BY 1",
        "concept_types": f"SELECT concept_type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM ({c}) GROUP BY 1",
        "concept_density": f"WITH {FILES}, l AS (SELECT sum(len(string_split(content, chr(10))))::BIGINT AS n_lines FROM files), k AS (SELECT count(*) AS n_concepts FROM ({c})) SELECT n_concepts, n_lines, round(n_concepts / n_lines * 1000, 4) AS density FROM k, l",
        "insights_page": f"WITH h AS (SELECT id, name FROM ({c}) WHERE lower(concept_type) = 'method' AND contains(lower(name), 'cache')) SELECT id, name, (SELECT count(*) FROM h) AS total FROM h ORDER BY name, id LIMIT 10",
    }
