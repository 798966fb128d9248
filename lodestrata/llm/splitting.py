"""Splitting oversized items at natural boundaries (problem 5).

Method: content-defined chunking. A rolling hash over the last ``WINDOW`` characters marks landmarks; the piece ends
at the natural boundary nearest to the first landmark between the minimum and maximum size. Since a landmark depends
on the characters before it alone, an edit alters only the pieces around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 32
#: On average one landmark in so many characters.
LANDMARK_EVERY = 512
#: A symbol boundary is taken instead of a nearer line end if it is at most this far from the landmark.
SYMBOL_REACH = 600

_LINE_END = re.compile(r"\r\n|\r|\n")


def _gear(codes: np.ndarray) -> np.ndarray:
    """A fixed 64-bit value of each code point (the mixing function of splitmix64)."""
    x = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def landmarks(text: str, every: int = LANDMARK_EVERY) -> np.ndarray:
    """Offsets after which the rolling hash of the last WINDOW characters hits; the hash doubles its reach per pass."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _gear(codes)
    reach = 1
    with np.errstate(over="ignore"):
        while reach < WINDOW:
            older = np.zeros_like(h)
            older[reach:] = h[:-reach]
            h = h + (older << np.uint64(reach))
            reach *= 2
    # The upper half depends on the whole window, while the lowest bits see only the latest characters.
    hits = np.flatnonzero((h >> np.uint64(40)) % np.uint64(every) == 0) + 1
    return hits[hits >= WINDOW]


def line_starts(text: str) -> np.ndarray:
    """Offsets of the lines' starts, the first being 0."""
    return np.array([0, *(m.end() for m in _LINE_END.finditer(text))], np.int64)


def cut_points(text: str, boundary_lines: list[int], limit: int, overlap: int, least: int) -> list[tuple[int, str]]:
    """(end offset, kind) of each piece; kind is symbol, line, hard or end.

    boundary_lines: 1-based lines at which a symbol begins, or follows on one that has ended.
    """
    room = limit - overlap
    n = len(text)
    starts = line_starts(text)
    symbols = np.unique(np.array([starts[line - 1] for line in boundary_lines if 0 < line <= len(starts)], np.int64))
    marks = landmarks(text)
    cuts: list[tuple[int, str]] = []
    at = 0
    while n - at > (limit if not cuts else room):
        most = limit if not cuts else room
        low, high = at + least, at + most
        i = np.searchsorted(marks, low)
        mark = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        end, kind = _nearest(symbols, mark, low, high), "symbol"
        line = _nearest(starts, mark, low, high)
        if end is None or (line is not None and abs(end - mark) > max(SYMBOL_REACH, abs(line - mark))):
            end, kind = line, "line"
        if end is None:
            end, kind = mark, "hard"
        cuts.append((end, kind))
        at = end
    return [*cuts, (n, "end")]


def _nearest(values: np.ndarray, mark: int, low: int, high: int) -> int | None:
    i = int(np.searchsorted(values, mark))
    near = [int(v) for v in values[max(0, i - 1) : i + 1] if low <= v <= high]
    return min(near, key=lambda v: abs(v - mark)) if near else None


_PIECE = "item long, piece int, start int, finish int, boundary string, n_pieces int, text string"


def split_items(items: DataFrame, limit: int = 4000, overlap: int = 200, least: int = 1000) -> DataFrame:
    """Cut every item into pieces of at most ``limit`` code points: (item, piece, start, finish, boundary, n_pieces, text).

    items: (item long, content string, boundary_lines array<int>). Pieces are numbered from 0; ``start`` and ``finish``
    are 0-based offsets in code points, finish exclusive. Each piece but the first begins ``overlap`` characters before the
    end of the one before it. ``boundary`` says where a piece ends: at a symbol, a line, hard (no natural boundary
    in reach) or end. Null contents give no piece, empty contents one empty piece; null boundary_lines count as none.
    Whole contents are processed; rows are not moved.
    """
    if not 0 <= overlap < limit or not 1 <= least <= limit - overlap:
        raise ValueError("need 0 <= overlap < limit and 1 <= least <= limit - overlap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for item, text, lines in zip(*(batch.column(i).to_pylist() for i in range(3))):
                cuts = cut_points(text, [b for b in lines or [] if b is not None], limit, overlap, least)
                at = 0
                for piece, (end, kind) in enumerate(cuts):
                    begin = max(0, at - overlap) if piece else 0
                    for column, value in zip(out, (item, piece, begin, end, kind, len(cuts), text[begin:end])):
                        column.append(value)
                    at = end
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
            names = ["item", "piece", "start", "finish", "boundary", "n_pieces", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return (
        items.select("item", "content", F.col("boundary_lines").cast("array<int>").alias("boundary_lines"))
        .where("content IS NOT NULL")
        .mapInArrow(run, _PIECE)
    )
