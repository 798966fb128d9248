"""Queries of the training-data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import docpairs, functions, neighbours, packing, provenance, splitting, syntax, tokens, truncation
from lodestrata.session import durable
from lodestrata.sources.tables import FILE_EVENTS, current_contents, latest_contents, table

Query = Callable[[SparkSession, str], DataFrame]

PIECE_LIMIT = 4000
PIECE_OVERLAP = 200
BIN_CAPACITY = 2048
#: Characters of the chunks whose maps are reduced over partitions.
CHUNK = 2048


_KINDS = ("function", "method", "constructor")


def _function_symbols(spark: SparkSession, directory: str) -> DataFrame:
    return (
        table(spark, directory, "symbols").where(F.col("kind").isin(*_KINDS))
        .select("symbol_id", F.col("file_path").alias("path"), "name", "signature", F.when(F.col("kind") == "constructor", F.col("parent")).alias("context"), F.col("start_line").alias("line"), "docstring")
        .dropDuplicates(["symbol_id"])
    )


def _function_concepts(spark: SparkSession, directory: str) -> DataFrame:
    return (
        table(spark, directory, "semantic_concepts").where(F.col("concept_type").isin("function", "method") & F.col("description").isNotNull())
        .select(F.lit("semantic_concepts").alias("table_name"), F.col("id").alias("record_id"), "name", "signature", F.lit(None).cast("string").alias("context"), F.col("description").alias("doc"))
        .dropDuplicates(["record_id"])
    )


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Functions and methods of symbols and concepts whose documentation says something."""
    symbols = _function_symbols(spark, directory)
    silent = symbols.where("docstring IS NULL")
    comments = docpairs.attached_comments(silent.select("path", "line"), latest_contents(table(spark, directory, "file_changes")))
    common = [F.lit("symbols").alias("table_name"), F.col("symbol_id").cast("string").alias("record_id"), "name", "signature", "context"]
    spoken = symbols.where("docstring IS NOT NULL").select(*common, F.col("docstring").alias("doc"))
    read = silent.join(comments, ["path", "line"]).select(*common, "doc")
    judged = docpairs.judge(spoken.unionByName(read).unionByName(_function_concepts(spark, directory)))
    return judged.where("informative").select("table_name", "record_id").distinct()


def p1_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Code and description of every documented function.

    Functions come from the files themselves (table_name is files, record_id null, where symbols do not know them); a symbol
    whose line begins none, and concepts, give their signature as code. The docstring of a symbol goes before what is attached.
    """
    found = durable(functions.extract(latest_contents(table(spark, directory, "file_changes"))))
    symbols = durable(_function_symbols(spark, directory))
    lines = found.select("path", "first", F.explode(F.sequence("first", F.col("line"))).alias("line"))
    known = symbols.join(lines, ["path", "line"]).groupBy("path", "first").agg(F.min(F.struct("symbol_id", "signature", "context", "docstring")).alias("s"))
    matched = symbols.join(lines.select("path", "line").distinct(), ["path", "line"], "left_semi").select("symbol_id")
    # The code, which is most of the bytes, joins at the end.
    heads = found.select("path", "first", "last", "name", "doc", "in_broken_file", F.substring_index("code", "\n", 1).alias("head"))
    of_files = heads.join(known, ["path", "first"], "left").select(
        F.when(F.col("s").isNull(), "files").otherwise("symbols").alias("table_name"), F.col("s.symbol_id").cast("string").alias("record_id"), "path", "first", "last", "name",
        F.coalesce("s.signature", "head").alias("signature"), "s.context", F.coalesce("s.docstring", "doc").alias("doc"), "in_broken_file",
    )
    nowhere = [F.lit(None).cast(t).alias(n) for n, t in (("path", "string"), ("first", "int"), ("last", "int"))] + [F.lit(None).cast("boolean").alias("in_broken_file")]
    alone = symbols.join(matched, "symbol_id", "left_anti").select(
        F.lit("symbols").alias("table_name"), F.col("symbol_id").cast("string").alias("record_id"), "name", "signature", "context", F.col("docstring").alias("doc"), *nowhere
    )
    concepts = _function_concepts(spark, directory).select("*", *nowhere)
    judged = docpairs.judge(of_files.unionByName(alone).unionByName(concepts)).where("informative")
    common = ["table_name", "record_id", "path", F.col("first").alias("first_line"), F.col("last").alias("last_line"), "name"]
    with_code = judged.where("path IS NOT NULL").join(found.select("path", "first", "last", "name", "code"), ["path", "first", "last", "name"]).select(*common, "code", "description", "in_broken_file")
    without = judged.where("path IS NULL").select(*common, F.coalesce("signature", "name").alias("code"), "description", "in_broken_file")
    return with_code.unionByName(without)


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    checked = syntax.check_files(current_contents(table(spark, directory, "file_changes")))
    return checked.where("NOT valid").select(F.col("path").alias("file_path")).distinct()


def p4_rates(spark: SparkSession, directory: str) -> DataFrame:
    return syntax.rates(syntax.check_files(current_contents(table(spark, directory, "file_changes"))))


def p4_balance(spark: SparkSession, directory: str) -> DataFrame:
    """Whether each current file's literals, comments and brackets are closed, from the maps of chunks that lie anywhere."""
    rows = syntax.chunk_rows(current_contents(table(spark, directory, "file_changes")), CHUNK)
    return syntax.chunk_spans(rows).select(F.col("path").alias("file_path"), "balanced")


def _oversized(spark: SparkSession, directory: str, limit: int) -> DataFrame:
    """Changes with content above the limit and the symbol boundaries of their text.

    symbols describe the latest content of a path, so only the change that holds it gets boundaries.
    """
    changes = table(spark, directory, "file_changes")
    large = changes.where(F.length("content") > limit).select("change_id", "path", "ts", "content").dropDuplicates(["change_id"])
    newest = (
        changes.where("content IS NOT NULL").select("path", "ts", "change_id")
        .groupBy("path").agg(F.max(F.struct("ts", "change_id")).alias("last")).select(F.col("last.change_id").alias("change_id"), F.lit(True).alias("is_latest"))
    )
    # Distinct lines, so a path's list is no longer than its text has lines.
    lines = (
        table(spark, directory, "symbols")
        .select(F.col("file_path").alias("path"), F.explode(F.array("start_line", F.col("end_line") + 1)).alias("line"))
        .groupBy("path").agg(F.collect_set("line").alias("lines"))
    )
    return (
        large.join(newest, "change_id", "left").join(lines, "path", "left")
        .select(F.col("change_id").alias("item"), "path", "content", F.when(F.col("is_latest"), F.col("lines")).alias("boundary_lines"))
    )


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return p5_pieces(spark, directory).where("n_pieces > 1").select("change_id").distinct()


def p5_pieces(spark: SparkSession, directory: str) -> DataFrame:
    pieces = splitting.split_items(_oversized(spark, directory, PIECE_LIMIT), PIECE_LIMIT, PIECE_OVERLAP)
    return pieces.select(F.col("item").alias("change_id"), "piece", "start", "finish", "boundary", "n_pieces", "text")


def p5_pieces_hold(spark: SparkSession, directory: str) -> DataFrame:
    """Per oversized change: its length as the pieces cover it, whether they keep the limit and the overlap, and join to the text."""
    pieces = splitting.split_items(_oversized(spark, directory, PIECE_LIMIT), PIECE_LIMIT, PIECE_OVERLAP)
    per_item = Window.partitionBy("item").orderBy("piece")
    before = F.lag("finish").over(per_item)
    own = F.substring("text", F.when(before.isNull(), F.lit(1)).otherwise(before - F.col("start") + 1), PIECE_LIMIT)
    checked = pieces.select("item", "piece", "finish", own.alias("own"), (F.length("text") <= PIECE_LIMIT).alias("short"), F.coalesce(before - F.col("start") == PIECE_OVERLAP, F.col("start") == 0).alias("laps"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "own"))), lambda p: p["own"]), "")
    return checked.groupBy(F.col("item").alias("change_id")).agg(
        F.max("finish").cast("long").alias("n_chars"), F.min("short").alias("within_limit"), F.min("laps").alias("overlaps"), F.sha2(text, 256).alias("text_hash")
    )


def _judged_files(spark: SparkSession, directory: str) -> DataFrame:
    """Every path of a file event or a concept, with its latest content where there is one."""
    files = latest_contents(table(spark, directory, "file_changes")).where("last_event IS NOT NULL").select("path", "content")
    concepts = table(spark, directory, "semantic_concepts").where("file_path IS NOT NULL").select(F.col("file_path").alias("path")).distinct()
    unknown = concepts.join(table(spark, directory, "file_changes").where(F.col("event_type").isin(*FILE_EVENTS)).select("path"), "path", "left_anti")
    return provenance.classify(files.unionByName(unknown.withColumn("content", F.lit(None).cast("string"))))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return _judged_files(spark, directory).where("kind IS NOT NULL").select(F.col("path").alias("file_path"))


def p6_kinds(spark: SparkSession, directory: str) -> DataFrame:
    return _judged_files(spark, directory).select(F.col("path").alias("file_path"), F.coalesce("kind", F.lit("hand_written")).alias("kind"), "reason")


def _vectors(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "vectors").select("id", F.col("concept_type").alias("kind"), "embedding")


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return neighbours.similar_pairs(_vectors(spark, directory))


def p7_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    return neighbours.nearest(_vectors(spark, directory))


def p7_neighbours_in_type(spark: SparkSession, directory: str) -> DataFrame:
    return neighbours.nearest(_vectors(spark, directory), within_kind=True)


def p8_ids(spark: SparkSession, directory: str) -> DataFrame:
    return tokens.encode(table(spark, directory, "documents"), keep=["doc_id"])


def p9_bins(spark: SparkSession, directory: str) -> DataFrame:
    sizes = tokens.count_tokens(table(spark, directory, "documents"), keep=["doc_id"])
    packed = packing.pack(sizes.select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size")), BIN_CAPACITY)
    return packed.select(F.col("item").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), "bin_id")


def p9_report(spark: SparkSession, directory: str) -> DataFrame:
    packed = p9_bins(spark, directory).select(F.col("n_tokens").alias("size"), "bin_id")
    return packing.fill_report(packed, BIN_CAPACITY)


def p9_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Whether every document is placed, no bin is overfull, and only documents above the capacity are split."""
    packed = durable(p9_bins(spark, directory))
    bins = packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > BIN_CAPACITY).alias("n_overfull"))
    per = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("size"))
    placed = per.agg(F.count(F.lit(1)).alias("n_placed"), F.count_if((F.col("n") > 1) & (F.col("size") <= BIN_CAPACITY)).alias("n_split_in_vain"))
    asked = table(spark, directory, "documents").agg(F.count(F.lit(1)).alias("n_documents"))
    return asked.crossJoin(placed).crossJoin(bins).select("n_documents", "n_placed", "n_overfull", "n_split_in_vain")


def _judged_documents(spark: SparkSession, directory: str) -> DataFrame:
    return truncation.truncated(table(spark, directory, "documents").select("doc_id", "source", "text"))


def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    return _judged_documents(spark, directory).where("truncated").select("doc_id").distinct()


def p10_shares(spark: SparkSession, directory: str) -> DataFrame:
    return truncation.shares(_judged_documents(spark, directory))


def p10_limits(spark: SparkSession, directory: str) -> DataFrame:
    ends = durable(truncation.endings(truncation.parse(table(spark, directory, "documents"))))
    return truncation.length_hazards(ends).where("significant").drop("significant")


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_pairs": p1_pairs,
        "p4_found": p4_found,
        "p4_rates": p4_rates,
        "p4_balance": p4_balance,
        "p5_found": p5_found,
        "p5_pieces": p5_pieces,
        "p5_pieces_hold": p5_pieces_hold,
        "p6_found": p6_found,
        "p6_kinds": p6_kinds,
        "p7_found": p7_found,
        "p7_neighbours": p7_neighbours,
        "p7_neighbours_in_type": p7_neighbours_in_type,
        "p8_ids": p8_ids,
        "p9_bins": p9_bins,
        "p9_report": p9_report,
        "p9_documents": p9_documents,
        "p10_found": p10_found,
        "p10_shares": p10_shares,
        "p10_limits": p10_limits,
    }


_USABLE = """
u AS (
  SELECT id, any_value(concept_type) AS concept_type, any_value(list_transform(embedding, lambda x: x::DOUBLE)) AS e FROM vectors
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY id
),
s AS (
  SELECT a.id AS id, b.id AS other, list_cosine_similarity(a.e, b.e) AS sim FROM u a JOIN u b ON a.id <> b.id
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"SELECT DISTINCT change_id FROM file_changes WHERE length(content) > {PIECE_LIMIT}",
        "p5_pieces_hold": f"""SELECT DISTINCT change_id, length(content) AS n_chars, true AS within_limit, true AS overlaps, sha256(content) AS text_hash FROM file_changes WHERE length(content) > {PIECE_LIMIT}""",
        "p9_documents": "SELECT count(*) AS n_documents, count(DISTINCT doc_id) AS n_placed, 0::BIGINT AS n_overfull, 0::BIGINT AS n_split_in_vain FROM documents",
        "p7_found": f"""WITH {_USABLE}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS place FROM s)
            SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM r WHERE place <= 10 AND sim >= 0.9""",
    }
