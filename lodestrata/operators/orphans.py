"""References to records that are missing, deleted or not there yet.

Method: parent events and references become one stream, range-partitioned and sorted by (key, time), so
that even one key with a third of all rows is spread over many tasks. Each task merges its stretch
linearly: the last parent event before a reference decides the parent's validity. A stretch whose first
key began in an earlier task takes the state from the earlier stretches' ends, of which there is one small
row per task. Nothing is gathered per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import durable, parallelism

REFERENCE_COLUMNS = ("table_name", "record_id", "kind", "key", "at")
PARENT_COLUMNS = ("kind", "key", "at", "seq", "alive")

_MERGED = "part int, row_kind int, table_name string, record_id string, kind string, key string, at timestamp_ntz, state int"


def _merge_stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, references with the state of their parent out.

    state 1 alive, 0 not alive, 2 unknown here (no parent event of the key before it in this stretch).
    row_kind 0 is a reference; the last row, of row_kind 1, is the end of the stretch: its last key and the
    state there.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last_key: tuple[str, str] | None = None
    last_state = 2
    for batch in batches:
        frame = batch.to_pandas()
        if frame.empty:
            continue
        kind, key = frame["kind"].to_numpy(object), frame["key"].to_numpy(object)
        n = len(frame)
        starts = np.empty(n, bool)
        starts[0] = (kind[0], key[0]) != last_key
        starts[1:] = (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])
        alive = frame["alive"].to_numpy(np.int32)
        is_parent = alive >= 0
        index = np.arange(n)
        last_parent = np.maximum.accumulate(np.where(is_parent, index, -1))
        key_start = np.maximum.accumulate(np.where(starts, index, -1))
        carried = 2 if starts[0] else last_state
        state = np.where(last_parent >= np.maximum(key_start, 0), alive[np.maximum(last_parent, 0)], np.where(key_start < 0, carried, 2))
        last_key, last_state = (kind[-1], key[-1]), int(state[-1])
        refs = frame.loc[~is_parent, ["table_name", "record_id", "kind", "key", "at"]].copy()
        refs.insert(0, "row_kind", np.int32(0))
        refs.insert(0, "part", np.int32(part))
        refs["state"] = state[~is_parent].astype(np.int32)
        yield _batch(refs)
    if last_key is not None:
        yield _batch(
            pd.DataFrame(
                {"part": [part], "row_kind": [1], "table_name": [None], "record_id": [None], "kind": [last_key[0]], "key": [last_key[1]], "at": [pd.NaT], "state": [last_state]}
            )
        )


_ARROW = pa.schema(
    [("part", pa.int32()), ("row_kind", pa.int32()), ("table_name", pa.string()), ("record_id", pa.string()), ("kind", pa.string()), ("key", pa.string()), ("at", pa.timestamp("us")), ("state", pa.int32())]
)


def _batch(frame: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(frame, schema=_ARROW, preserve_index=False)


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose parent does not exist at their time.

    references: (table_name, record_id, kind, key, at); parents: (kind, key, at, seq, alive boolean), one row
    per event after which the parent exists or not; seq orders events of the same time. Other columns are ignored. A parent event at the same time
    as a reference comes first. Result: the distinct references plus ``reason``: ``missing`` (the key never
    exists), ``deleted`` (it existed before), ``late`` (it exists only later).

    References or events with a null key are left out; a null ``at`` of a reference counts as before all
    events, events with a null ``at`` are ignored. Repeated rows count once. Empty tables give an empty
    result, and with no parents every reference is missing.
    """
    refs = references.select(*REFERENCE_COLUMNS).where(F.col("key").isNotNull())
    events = parents.select(*PARENT_COLUMNS).where(F.col("key").isNotNull() & F.col("at").isNotNull())
    stream = refs.select(*REFERENCE_COLUMNS, F.lit(-1).alias("alive"), F.lit(0).cast("long").alias("seq")).unionByName(
        events.select(
            F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("string").alias("record_id"), "kind", "key", "at",
            F.col("alive").cast("int").alias("alive"), F.col("seq").cast("long").alias("seq"),
        )
    )
    order = ["kind", "key", "at", (F.col("alive") < 0), "seq", "table_name", "record_id"]
    spread = stream.repartitionByRange(parallelism(stream.sparkSession), *order).sortWithinPartitions(*order)
    merged = durable(spread.mapInArrow(_merge_stretch, _MERGED))

    # One row per task, so its number is bounded by the number of partitions. Of the stretches before a
    # reference's own, those that end in the reference's key tell its state; the last one that knows counts.
    ends = merged.where("row_kind = 1 AND state < 2").select(F.col("part").alias("end_part"), F.col("kind").alias("k"), F.col("key").alias("e"), F.col("state").alias("end_state"))
    open_refs = merged.where("row_kind = 0 AND state = 2")
    carried = (
        open_refs.join(F.broadcast(ends), (F.col("kind") == F.col("k")) & (F.col("key") == F.col("e")) & (F.col("end_part") < F.col("part")), "left")
        .groupBy("table_name", "record_id", "kind", "key", "at")
        .agg(F.max_by("end_state", "end_part").alias("state"))
    )
    known = merged.where("row_kind = 0 AND state < 2").select("table_name", "record_id", "kind", "key", "at", "state")
    dead = known.unionByName(carried).where("state IS NULL OR state = 0").distinct()
    first_alive = events.where("alive").groupBy(F.col("kind").alias("k"), F.col("key").alias("e")).agg(F.min("at").alias("first_at"))
    return dead.join(first_alive, (F.col("kind") == F.col("k")) & (F.col("key") == F.col("e")), "left").select(
        "table_name",
        "record_id",
        "kind",
        F.col("key").alias("target"),
        "at",
        F.when(F.col("first_at").isNull(), "missing").when(F.col("first_at") <= F.col("at"), "deleted").otherwise("late").alias("reason"),
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month of ``at`` and reason; a null ``at`` gives a null month."""
    return orphans.groupBy("table_name", F.date_format("at", "yyyy-MM").alias("month"), "reason").agg(
        F.count(F.lit(1)).alias("n_references"), F.count_distinct("record_id").alias("n_records")
    )
