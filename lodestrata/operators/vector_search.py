"""Vector search (F3): exact cosine ranking, threshold, filters, and the text fallback."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

THRESHOLD = 0.5


def usable(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Vectors of the dimension with finite components that are not all zero."""
    e = F.col(column).cast("array<double>")
    return vectors.where(F.size(column) == dim).where(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))).where(F.exists(e, lambda x: x != 0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where one of the vectors is zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cosine_to(query: list[float], column: str = "embedding") -> Column:
    """Cosine to a fixed vector, as a sum that code generation unrolls instead of an interpreted lambda."""
    length = math.sqrt(sum(v * v for v in query))
    e = F.col(column)
    inner = sum((F.get(e, i).cast("double") * F.lit(float(v)) for i, v in enumerate(query)), F.lit(0.0))
    own = F.sqrt(sum((F.get(e, i).cast("double") * F.get(e, i).cast("double") for i in range(len(query))), F.lit(0.0)))
    return F.when(own > 0, inner / (own * F.lit(length))) if length > 0 else F.lit(None).cast("double")


def search(vectors: DataFrame, query: list[float], key: str = "id", limit: int = 10, threshold: float | None = THRESHOLD, filters: dict[str, object] | None = None, column: str = "embedding") -> DataFrame:
    """(key, score): the most similar vectors of the filtered ones, ties by key. Filters are equalities on other columns; null
    filters are ignored. Repeated rows count once: keys and scores are compared, after filtering, so that no vector is moved."""
    kept = vectors
    for name, value in (filters or {}).items():
        if value is not None:
            kept = kept.where(F.col(name) == F.lit(value))
    scored = usable(kept, len(query), column).select(key, F.round(cosine_to(query, column), 5).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.distinct().orderBy(F.col("score").desc(), key).limit(limit)


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, column: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) for a small table of queries (query_id, query), checked to be small before it is sent out.

    Each batch of vectors is compared with all queries by one product of matrices, and hands on each query's k best of
    the batch. Queries above the bound have to be split by the caller into several calls. Zero vectors have no score.
    """
    bound = 10_000
    asked = queries.select("query_id", "query").limit(bound + 1).toPandas()
    if len(asked) > bound:
        raise ValueError(f"more than {bound} queries; search them in blocks")
    schema = StructType([queries.schema["query_id"], vectors.schema["id"], StructField("score", DoubleType())])
    if not len(asked):
        return vectors.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))

    def unit(rows) -> np.ndarray:  # noqa: ANN001
        m = np.stack(rows).astype(np.float64)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, length, out=np.full_like(m, np.nan), where=length > 0)

    ids, turned = asked["query_id"].to_numpy(), unit(asked["query"]).T

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            names, units = batch["id"].to_numpy(), unit(batch["e"])
            order = np.argsort(names, kind="stable")
            for at in range(0, turned.shape[1], 256):
                block = np.round(units[order] @ turned[:, at : at + 256], 5)
                # Ties go to the lesser id, since the rows stand in its order.
                top = np.argsort(-np.nan_to_num(block, nan=-np.inf), axis=0, kind="stable")[:k]
                column = np.repeat(np.arange(block.shape[1])[None], len(top), axis=0)
                found = pd.DataFrame({"query_id": ids[at + column.ravel()], "id": names[order][top.ravel()], "score": block[top.ravel(), column.ravel()]})
                yield found[found["score"].notna()]

    scored = vectors.select("id", F.col(column).alias("e")).mapInPandas(score, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def text_score(query: str, name: Column, kind: Column) -> Column:
    """Fallback without vectors: equal names 1, query in name 0.7, name in query 0.5, else 0.3 per shared word; 0.2 more if the
    type stands in the query; at most 1."""
    wanted = query.lower()
    lower = F.lower(name)
    parts = F.split(F.regexp_replace(lower, r"[_\-.]", " "), " ")
    shared = F.size(F.array_intersect(F.array(*map(F.lit, wanted.split())), parts))
    base = F.when(lower == wanted, 1.0).when(lower.contains(wanted), 0.7).when(F.lit(wanted).contains(lower), 0.5).otherwise(0.3 * shared)
    bonus = F.when(F.lit(wanted).contains(F.lower(F.coalesce(kind, F.lit("\x00")))), 0.2).otherwise(0.0)
    return F.when(base > 0, F.least(base + bonus, F.lit(1.0))).otherwise(bonus)


def text_fallback(concepts: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, name, score) of concepts (id, name, concept_type) that score above 0."""
    return (
        concepts.select("id", "name", F.round(text_score(query, F.col("name"), F.col("concept_type")), 5).alias("score"))
        .where("score > 0").orderBy(F.col("score").desc(), "id").limit(limit)
    )


def embedding_text(kind: Column, name: Column, signature: Column, docstring: Column, decorators: Column) -> Column:
    """The text that is embedded for a symbol: kind and name, signature, start of the docstring, decorators; at most 500 characters."""
    lines = F.array(F.concat(kind, F.lit(": "), name), F.nullif(signature, F.lit("")), F.substring(F.nullif(docstring, F.lit("")), 1, 300), F.when(F.size(decorators) > 0, F.array_join(decorators, ", ")))
    return F.substring(F.array_join(F.array_compact(lines), "\n"), 1, 500)


def point_id(path: Column, name: Column, kind: Column) -> Column:
    """Deterministic id of a vector, so that repeated indexing replaces it."""
    return F.substring(F.sha2(F.concat_ws(":", name, kind, path), 256), 1, 16)
