"""Filling fixed-capacity containers with items of varying size (problem 9).

Method: bounded-space online best-fit. A packer keeps a fixed number of open bins in a bitset keyed by free
space; an item goes to the bin with the least free space that holds it, and when a new bin is needed and all are
open, the fullest closes. Items are packed in shards of bounded size, whose number depends on the items alone; the bins
that are still open at the end of a shard, at most ``open_bins`` of them, are unpacked, and the same packer packs them
again together with those of other shards, with no more bins open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import durable, parallelism

#: Pieces of a shard on average, and shards whose open bins are packed together in the second round.
SHARD_PIECES = 16_384
FAN_IN = 64
#: Items of size 0 that wait for a bin; more of them get one of their own.
EMPTY_MOST = 65_536


class Packer:
    """Bounded-space best-fit: ``put`` returns the bin number of an item of 0 <= size <= capacity."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free_bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            del self.by_free[free]
            self.free_bits ^= 1 << free
        return number

    def _store(self, free: int, number: int) -> None:
        self.by_free.setdefault(free, []).append(number)
        self.free_bits |= 1 << free

    def put(self, size: int) -> int:
        fits = self.free_bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
            free -= size
        else:
            if self.n_open == self.open_bins:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
                self.n_open -= 1
            number, free = self.n_bins, self.capacity - size
            self.n_bins += 1
            self.n_open += 1
        if free:
            self._store(free, number)
        else:
            self.n_open -= 1
        return number

    def open_numbers(self) -> set[int]:
        return {n for bins in self.by_free.values() for n in bins}


_ITEM = "item long, piece int, size int"
_PACKED = f"{_ITEM}, shard long, bin long, open boolean"
_SCHEMA = pa.schema([("item", pa.int64()), ("piece", pa.int32()), ("size", pa.int32()), ("shard", pa.int64()), ("bin", pa.int64()), ("open", pa.bool_())])


def _pack_runs(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: int | None = None
        packer = Packer(capacity, open_bins)
        # Rows of open bins wait until their bin closes or the shard ends, so at most open_bins bins are held.
        waiting: dict[int, list[tuple[int, int, int]]] = {}
        # Items of size 0 fit every bin, so they go to one that has closed, and wait only until one has.
        empty: list[tuple[int, int, int]] = []
        last_closed = -1

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _SCHEMA)] if rows else [pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)

        def flush(numbers: list[int], still_open: bool, at: int | None) -> pa.RecordBatch:
            return batch_of([(*row, at, n, still_open) for n in numbers for row in waiting.pop(n)])

        def place_empty(at: int | None) -> pa.RecordBatch:
            # Number -1 is the shard's bin of empty items, used where no bin has closed.
            rows = [(*row, at, last_closed, False) for row in empty]
            empty.clear()
            return batch_of(rows)

        for batch in batches:
            for item, piece, size, own in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own != shard:
                    if shard is not None:
                        # Bins that have closed since the last batch are not packed again.
                        now_open = packer.open_numbers()
                        closed = [n for n in waiting if n not in now_open]
                        if closed:
                            last_closed = closed[-1]
                            yield flush(closed, False, shard)
                        if waiting and empty and last_closed < 0:
                            waiting[next(iter(waiting))].extend(empty)
                            empty.clear()
                        yield flush(list(waiting), True, shard)
                        yield place_empty(shard)
                    shard, packer, last_closed = own, Packer(capacity, open_bins), -1
                if size:
                    waiting.setdefault(packer.put(size), []).append((item, piece, size))
                else:
                    empty.append((item, piece, size))
            now_open = packer.open_numbers()
            closed = [n for n in waiting if n not in now_open]
            if closed:
                last_closed = closed[-1]
                yield flush(closed, False, shard)
            if empty and (last_closed >= 0 or len(empty) > EMPTY_MOST):
                yield place_empty(shard)
        if waiting and empty and last_closed < 0:
            waiting[next(iter(waiting))].extend(empty)
            empty.clear()
        if waiting:
            yield flush(list(waiting), True, shard)
        if empty:
            yield place_empty(shard)

    return run


def pieces_of(items: DataFrame, capacity: int) -> DataFrame:
    """(item, piece, size): items above the capacity are cut into full pieces and a rest, others are one piece.

    A null or negative size counts as 0.
    """
    size = F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0))
    pieces = F.greatest(F.ceil(size / capacity), F.lit(1)).cast("int")
    return (
        items.select("item", size.alias("whole"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
        .select("item", "piece", F.least(F.lit(capacity), F.col("whole") - F.col("piece") * capacity).cast("int").alias("size"))
    )


def pack(items: DataFrame, capacity: int, open_bins: int = 64, shards: int | None = None) -> DataFrame:
    """Assign every piece of every item to a bin: (item, piece, size, bin_id).

    items: (item long, size). No bin holds more than ``capacity``; only items above it are split. Items of size
    0 take a place in some bin. Repeated item ids are packed as often as they come. An empty table gives an
    empty result. Only ids and sizes are shuffled; a shard is packed as a stream in the order of its ids.
    """
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be positive")
    # Sizes cost more than packing, so they are taken once.
    sized = durable(pieces_of(items, capacity))
    count = shards or max(1, -(-sized.count() // SHARD_PIECES))
    tasks = parallelism(items.sparkSession)
    placed = sized.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(count)))
    first = durable(
        placed.repartition(min(tasks, count), "shard").sortWithinPartitions("shard", "item", "piece")
        .select("item", "piece", "size", "shard").mapInArrow(_pack_runs(capacity, open_bins), _PACKED)
    )
    merged = -(-count // FAN_IN)
    again = (
        first.where("open").withColumn("shard", F.floor(F.col("shard") / FAN_IN))
        .repartition(min(tasks, merged), "shard").sortWithinPartitions("shard", "item", "piece")
        .select("item", "piece", "size", "shard").mapInArrow(_pack_runs(capacity, open_bins), _PACKED)
    )
    label = lambda level: F.concat_ws("-", F.lit(level), "shard", "bin").alias("bin_id")
    return first.where("NOT open").select("item", "piece", "size", label("a")).unionByName(again.select("item", "piece", "size", label("b")))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: number of bins and pieces, tokens and the share of the bins' room that is used (null without bins)."""
    bins = packed.groupBy("bin_id").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return bins.agg(
        F.count(F.lit(1)).alias("n_bins"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("n_pieces"), F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
        F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill"),
    )
