"""Queries: text, pattern and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import pattern_search, text_search, vector_search
from lodestrata.plans import common
from lodestrata.plans.common import FILES, SEARCH_RULE_VALUES, Query, count_matches, documents, source
from lodestrata.sources.tables import table

TEXT = "cache"
CUSTOM = r"return \w+Total"
QUERY_WORDS = "shared cache service"
#: A fixed query vector: the cosines of equal steps.
QUERY_VECTOR = [round(((i * 37) % 64 - 31.5) / 31.5, 6) for i in range(64)]


def text_search_files(spark: SparkSession, d: str) -> DataFrame:
    return text_search.search(source(spark, d), TEXT)


def text_search_documents(spark: SparkSession, d: str) -> DataFrame:
    return text_search.search(documents(spark, d), TEXT, key="doc_id")


def text_search_language(spark: SparkSession, d: str) -> DataFrame:
    return text_search.search(documents(spark, d).where("lang = 'de'"), "lauf", key="doc_id")


def text_search_context(spark: SparkSession, d: str) -> DataFrame:
    return text_search.line_hits(source(spark, d), TEXT)


def text_search_first_hits(spark: SparkSession, d: str) -> DataFrame:
    """The same first hits by a window over exploded lines, as a check of the array form."""
    lines = source(spark, d).select("path", F.posexplode(F.split("content", "\n", -1)).alias("at", "text")).where(F.lower("text").contains(TEXT))
    return text_search.top_per_group(lines.select("path", (F.col("at") + 1).alias("line")), "path", [F.col("line")], 5)


def pattern_search_builtin(spark: SparkSession, d: str) -> DataFrame:
    return pattern_search.search(source(spark, d), "function")


def pattern_search_custom(spark: SparkSession, d: str) -> DataFrame:
    return pattern_search.search(source(spark, d), CUSTOM)


def pattern_search_guarded(spark: SparkSession, d: str) -> DataFrame:
    """An expression with nested quantifiers is refused, so nothing is found."""
    return pattern_search.search(source(spark, d), r"(a+)+b")


def pattern_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    counted = pattern_search.rule_counts(source(spark, d))
    return counted.groupBy("rule").agg(F.sum("n_matches").alias("n_matches"), F.count(F.lit(1)).alias("n_files"))


def pattern_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return pattern_search.catalogue(spark, "python").select("name", "language")


def pattern_spans(spark: SparkSession, d: str) -> DataFrame:
    found = pattern_search.spans(source(spark, d), [("py_class", "python", r"(?m)^class\s+(\w+)"), ("go_struct", "go", r"(?m)^type\s+(\w+)\s+struct")])
    return found.select("path", "rule", "line_start", "column_start", F.col("text").alias("matched_text"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vectors").select("id", "name", "concept_type", "language", "embedding")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.search(_vectors(spark, d), QUERY_VECTOR, threshold=None)


def vector_filtered(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.search(_vectors(spark, d), QUERY_VECTOR, threshold=0.1, filters={"language": "python", "concept_type": None})


def vector_embeddings_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.search(table(spark, d, "embeddings"), QUERY_VECTOR, key="vec_id", threshold=None, limit=20)


def vector_many_queries(spark: SparkSession, d: str) -> DataFrame:
    """One query per label: its least vector."""
    base = table(spark, d, "embeddings")
    queries = base.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query")).select(F.col("label").alias("query_id"), "query")
    return vector_search.search_many(base.select(F.col("vec_id").alias("id"), "embedding"), queries, k=5)


def vector_text_fallback(spark: SparkSession, d: str) -> DataFrame:
    concepts = table(spark, d, "semantic_concepts").select("id", "name", "concept_type").distinct()
    return vector_search.text_fallback(concepts, QUERY_WORDS, limit=20)


def vector_dimension_check(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("id", F.size("embedding").alias("dim")).distinct().groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where("dim IS NOT NULL AND dim >= 0")


def vector_index_texts(spark: SparkSession, d: str) -> DataFrame:
    s = common.symbols(spark, d)
    text = vector_search.embedding_text(F.col("kind"), F.col("name"), F.col("signature"), F.col("docstring"), F.col("decorators"))
    return s.select("symbol_id", F.sha2(text, 256).alias("text_hash"), vector_search.point_id(F.col("path"), F.col("name"), F.col("kind")).alias("point_id"))


def queries() -> dict[str, Query]:
    return {
        "text_search_files": text_search_files, "text_search_documents": text_search_documents, "text_search_language": text_search_language, "text_search_context": text_search_context,
        "text_search_first_hits": text_search_first_hits, "pattern_search_builtin": pattern_search_builtin, "pattern_search_custom": pattern_search_custom,
        "pattern_search_guarded": pattern_search_guarded, "pattern_rule_counts": pattern_rule_counts, "pattern_catalogue": pattern_catalogue, "pattern_spans": pattern_spans,
        "vector_topk": vector_topk, "vector_filtered": vector_filtered, "vector_embeddings_topk": vector_embeddings_topk, "vector_many_queries": vector_many_queries,
        "vector_text_fallback": vector_text_fallback, "vector_dimension_check": vector_dimension_check, "vector_index_texts": vector_index_texts,
    }


_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\v\x{{85}}\p{{Z}}]+', ''), '[\s\v\x{{85}}\p{{Z}}]+$', '')"


def _text_sql(relation: str, key: str, text: str) -> str:
    return f"""SELECT {key}, n_hits::INT AS n_hits, first_line::INT AS first_line, round(0.7 * least(n_hits / 5.0, 1.0) + 0.3 / (1.0 + n_lines / 1000.0), 6) AS score FROM (
        SELECT {key}, least(count(*) FILTER (WHERE hit), 5) AS n_hits, min(line) FILTER (WHERE hit) AS first_line, count(*) AS n_lines FROM (
          SELECT {key}, contains(lower(l.text), '{text}') AS hit, l.line FROM (
            SELECT {key}, unnest(list_transform(string_split(content, chr(10)), lambda t, i: {{'text': t, 'line': i}})) AS l FROM {relation}))
        GROUP BY {key}) WHERE n_hits > 0 ORDER BY score DESC, {key} LIMIT 50"""


_LINES = f"""{FILES}, lines AS (SELECT path, l.text, l.line, all_lines FROM (
    SELECT path, string_split(content, chr(10)) AS all_lines, unnest(list_transform(string_split(content, chr(10)), lambda t, i: {{'text': t, 'line': i}})) AS l FROM files)),
    hits AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS place FROM lines WHERE contains(lower(text), '{TEXT}'))"""

_VECTOR_LITERAL = "[" + ", ".join(f"{v!r}::DOUBLE" for v in QUERY_VECTOR) + "]"


def _vector_sql(relation: str, key: str, where: str, limit: int) -> str:
    return f"""SELECT {key}, score FROM (SELECT {key}, round(list_cosine_similarity(list_transform(embedding, lambda x: coalesce(x::DOUBLE, 0)), {_VECTOR_LITERAL}), 5) AS score FROM {relation}
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 {where})
        {'WHERE score >= 0.1' if where else ''} ORDER BY score DESC, {key} LIMIT {limit}"""


_ONE_VECTOR = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY id) AS rn FROM vectors) WHERE rn = 1)"


def oracle_sql() -> dict[str, str]:
    doc = "(SELECT doc_id, text AS content, lang FROM documents WHERE text IS NOT NULL)"
    counted = f"SELECT path, sum(n) AS n_matches, count(*) FILTER (WHERE n > 0) AS n_rules FROM (SELECT path, len(regexp_extract_all(content, pattern)) AS n FROM files, {SEARCH_RULE_VALUES} WHERE contains(rule, 'function') AND (lang IS NULL OR lang = language)) GROUP BY path"
    scored = "round(0.6 * least(n_matches / 10.0, 1.0) + 0.4 * least(n_rules / 5.0, 1.0), 6) AS score"
    words = QUERY_WORDS.split()
    return {
        "text_search_files": f"WITH {FILES} {_text_sql('files', 'path', TEXT)}",
        "text_search_documents": _text_sql(doc, "doc_id", TEXT),
        "text_search_language": _text_sql(f"(SELECT * FROM {doc} WHERE lang = 'de')", "doc_id", "lauf"),
        "text_search_context": f"WITH {_LINES} SELECT path, line::INT AS line, {_STRIP.format('text')} AS content, array_to_string(all_lines[greatest(line - 1, 1):line + 1], chr(10)) AS context FROM hits WHERE place <= 5",
        "text_search_first_hits": f"WITH {_LINES} SELECT path, line::INT AS line FROM hits WHERE place <= 5",
        "pattern_search_builtin": f"""WITH {FILES}, ruled AS ({counted}),
            own AS (SELECT f.path, CASE WHEN coalesce(r.n_matches, 0) > 0 THEN r.n_matches ELSE least({count_matches("f.content", "(?im)function")}, 10000) END AS n_matches,
                           CASE WHEN coalesce(r.n_matches, 0) > 0 THEN r.n_rules ELSE 1 END AS n_rules FROM files f LEFT JOIN ruled r USING (path))
            SELECT path, n_matches::BIGINT AS n_matches, n_rules::BIGINT AS n_rules, {scored} FROM own WHERE n_matches > 0 ORDER BY score DESC, n_matches DESC, path LIMIT 50""",
        "pattern_search_custom": f"""WITH {FILES}, own AS (SELECT path, {count_matches("content", "(?im)" + CUSTOM)} AS n_matches, 1 AS n_rules FROM files)
            SELECT path, n_matches::BIGINT AS n_matches, n_rules::BIGINT AS n_rules, {scored} FROM own WHERE n_matches > 0 ORDER BY score DESC, n_matches DESC, path LIMIT 50""",
        "pattern_search_guarded": "SELECT '' AS path, 0::BIGINT AS n_matches, 0::BIGINT AS n_rules, 0::DOUBLE AS score WHERE false",
        "pattern_rule_counts": f"""WITH {FILES} SELECT rule, sum(n)::BIGINT AS n_matches, count(*) AS n_files FROM (
            SELECT rule, len(regexp_extract_all(content, pattern)) AS n FROM files, {SEARCH_RULE_VALUES} WHERE lang IS NULL OR lang = language) WHERE n > 0 GROUP BY rule""",
        "pattern_spans": f"""WITH {FILES}, l AS (SELECT path, language, x.t AS t, x.i AS i FROM (SELECT path, language, unnest(list_transform(string_split(content, chr(10)), lambda t, i: {{'t': t, 'i': i}})) AS x FROM files))
            SELECT path, 'py_class' AS rule, i::INT AS line_start, 1 AS column_start, regexp_extract(t, '^class[ \\t]+\\w+') AS matched_text FROM l WHERE language = 'python' AND regexp_matches(t, '^class[ \\t]+\\w+')
            UNION ALL SELECT path, 'go_struct', i::INT, 1, regexp_extract(t, '^type[ \\t]+\\w+[ \\t]+struct') FROM l WHERE language = 'go' AND regexp_matches(t, '^type[ \\t]+\\w+[ \\t]+struct')""",
        "pattern_catalogue": f"SELECT rule AS name, lang AS language FROM {SEARCH_RULE_VALUES} WHERE lang IS NULL OR lang = 'python'",
        "vector_topk": _vector_sql(_ONE_VECTOR, "id", "", 10),
        "vector_filtered": _vector_sql(_ONE_VECTOR, "id", "AND language = 'python'", 10),
        "vector_embeddings_topk": _vector_sql("embeddings", "vec_id", "", 20),
        "vector_many_queries": """WITH q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS query FROM embeddings GROUP BY label),
            s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(query, lambda x: x::DOUBLE)), 5) AS score FROM embeddings, q)
            SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""",
        "vector_text_fallback": f"""WITH c AS (SELECT DISTINCT id, name, concept_type, string_split(regexp_replace(lower(name), '[_\\-.]', ' ', 'g'), ' ') AS parts FROM semantic_concepts),
            s AS (SELECT id, name, CASE WHEN lower(name) = '{QUERY_WORDS}' THEN 1.0 WHEN contains(lower(name), '{QUERY_WORDS}') THEN 0.7 WHEN contains('{QUERY_WORDS}', lower(name)) THEN 0.5
                    ELSE 0.3 * ({" + ".join(f"list_contains(parts, '{w}')::INT" for w in words)}) END AS base, CASE WHEN contains('{QUERY_WORDS}', lower(concept_type)) THEN 0.2 ELSE 0 END AS bonus FROM c)
            SELECT id, name, round(CASE WHEN base > 0 THEN least(base + bonus, 1.0) ELSE bonus END, 5)::DOUBLE AS score FROM s WHERE base > 0 OR bonus > 0 ORDER BY score DESC, id LIMIT 20""",
        "vector_dimension_check": f"SELECT len(embedding)::INT AS dim, count(*) AS n FROM {_ONE_VECTOR} WHERE embedding IS NOT NULL GROUP BY 1",
        "vector_index_texts": f"""WITH {common.SYMBOLS} SELECT symbol_id, sha256(substring(concat_ws(chr(10), kind || ': ' || name, nullif(signature, ''), substring(nullif(docstring, ''), 1, 300),
            CASE WHEN len(decorators) > 0 THEN array_to_string(decorators, ', ') END), 1, 500)) AS text_hash, substring(sha256(concat_ws(':', name, kind, path)), 1, 16) AS point_id FROM syms""",
    }
