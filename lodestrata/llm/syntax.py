"""Source files that do not parse (problem 4).

Method: the text is cut into chunks; each becomes a lexer-state map with bracket summaries, and the maps are
reduced associatively (``lexing``). Texts that are unbalanced are invalid; statements of balanced texts are
checked by local grammars (``grammar``, ``python_grammar``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import grammar, lexing, python_grammar
from lodestrata.sources.tables import path_extension, path_repository

LANGUAGES = ("py", "js", "ts", "go", "java", "json")

_JSON_CLASS = {"true": "v", "false": "v", "null": "v"} | {c: c for c in "{}[],:"}
#: Passes over nested values; deeper ones are reduced with a stack.
_PASSES = 60
_JSON_GROUP = re.compile(r"\{(?:s:[snv](?:,s:[snv])*)?\}|\[(?:[snv](?:,[snv])*)?\]")


def _json_fits(tokens: list[str]) -> bool:
    flat = "".join([_JSON_CLASS.get(t) or ("s" if t[0] == '"' and len(t) > 1 else "n" if t[-1].isdigit() else "?") for t in tokens])
    for _ in range(_PASSES):
        smaller = _JSON_GROUP.sub("v", flat)
        if smaller == flat:
            return flat in ("s", "n", "v")
        flat = smaller
    return grammar.reduce_nested(flat, lambda text: "v" if _JSON_GROUP.fullmatch(text) else "?") in ("s", "n", "v")


def is_valid(text: str, lang: str, size: int = lexing.CHUNK) -> bool:
    """Whether a whole text is syntactically valid in the language; empty text is, but for JSON and Go. size: characters of a chunk."""
    if lang == "py":
        # Line ends carry meaning, so the text begins with one.
        text = "\n" + text.removeprefix("﻿")
    elif lang != "json":
        text = text.removeprefix("﻿")
    span, tokens = lexing.lex(text, lang, size)
    if lang == "py":
        return span.balanced and python_grammar.fits(tokens) or python_grammar.parses(text[1:])
    if span.balanced and (_json_fits(tokens) if lang == "json" else grammar.language(lang).valid_tokens(tokens)):
        return True
    if lang not in ("js", "ts") or not _SLASH.search(text):
        return False
    # Only the statement tells whether a slash after a parenthesis divides; this is the other reading.
    span, tokens = lexing.lex(text, lang, size, after_head=True)
    return span.balanced and grammar.language(lang).valid_tokens(tokens)


_SLASH = re.compile(r"\) ?/(?![/*])")


def check_files(files: DataFrame) -> DataFrame:
    """(path, language, valid) of files (path, content); language is the lower-case extension.

    ``valid`` is null for null contents and for extensions other than py, js, ts, go, java and json. Rows are not
    moved and repeated rows stay. Texts of any length are read whole.
    """
    named = files.select("path", path_extension(F.col("path")).alias("language"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [
                None if text is None or lang not in LANGUAGES else is_valid(text, lang)
                for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts, pa.bool_())], ["path", "language", "valid"])

    return named.mapInArrow(run, "path string, language string, valid boolean")


def rates(checked: DataFrame) -> DataFrame:
    """Invalid files per repository and language: n_files, n_invalid, rate (files that were judged)."""
    return (
        checked.where("valid IS NOT NULL")
        .groupBy(path_repository(F.col("path")).alias("repo"), "language")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"))
        .withColumn("rate", F.col("n_invalid") / F.col("n_files"))
    )


def chunk_rows(files: DataFrame, size: int = lexing.CHUNK) -> DataFrame:
    """(path, pos, language, chunk): the chunks of files (path, content) in the known languages; rows are not moved."""
    named = files.where("content IS NOT NULL").select("path", path_extension(F.col("path")).alias("language"), "content").where(F.col("language").isin(*LANGUAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, pos, lang, chunk) for path, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3))) for pos, chunk in enumerate(lexing.chunks(text, size))]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))], ["path", "pos", "language", "chunk"])

    return named.mapInArrow(run, "path string, pos long, language string, chunk string")


def chunk_spans(chunk_rows: DataFrame) -> DataFrame:
    """Spans of files that are stored as several rows (path, pos, language, chunk): (path, balanced).

    All chunks but the first have to begin with a line end, as those of ``chunk_rows`` do. Each is summarised where it lies; only the small summaries are shuffled and
    reduced per path in the order of ``pos``.
    """
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, pos, lang, chunk in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for start, span in lexing.summarize(chunk or "", lang).items():
                    rows.append((path, pos, start, span.end, span.closers, span.openers, span.broken))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["path", "pos", "start", "end", "closers", "openers", "broken"])

    spans = chunk_rows.select("path", F.col("pos").cast("long").alias("pos"), "language", "chunk").mapInArrow(
        summarise, "path string, pos long, start string, end string, closers string, openers string, broken boolean"
    )

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total: dict[str, lexing.Span] | None = None
        for _, part in frame.sort_values("pos", kind="stable").groupby("pos"):
            own = {r.start: lexing.Span(r.end, r.closers, r.openers, bool(r.broken)) for r in part.itertuples()}
            total = own if total is None else lexing.combine(total, own)
        return pd.DataFrame({"path": [key[0]], "balanced": [total[lexing.CODE].balanced]})

    return spans.groupBy("path").applyInPandas(fold, "path string, balanced boolean")
