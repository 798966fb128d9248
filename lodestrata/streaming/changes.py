"""The change stream (F9): debounce, change detection by content hash, moves; for batches and for streams.

Streams need an event-time column of type timestamp; the batch forms keep timestamps without zone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators.store import latest_per_key
from lodestrata.operators.stretches import scan

DEBOUNCE = "500 milliseconds"


def should_ignore(path: Column, patterns: list[str]) -> Column:
    """A pattern without its stars and slashes stands anywhere in the path."""
    hit = F.lit(False)
    for pattern in patterns:
        bare = pattern.replace("*", "").strip("/")
        if bare:
            hit = hit | path.contains(bare)
    return hit


def matches(path: Column, globs: list[str]) -> Column:
    """``*.ext`` by its end, other globs as a whole."""
    if not globs:
        return F.lit(True)
    hit = F.lit(False)
    for glob in globs:
        if glob.startswith("*.") and "*" not in glob[2:]:
            hit = hit | path.endswith(glob[1:])
        else:
            hit = hit | path.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in glob) + "$")
    return hit


_RUNS = "stretch int, edge boolean, key string, number long, started long, ended long, n_events long, last_id long, event_type string, ts timestamp_ntz"


def debounce(events: DataFrame, gap_seconds: float = 0.5, key: str = "path", order: str = "change_id") -> DataFrame:
    """The last event of each run of events of a path that follow one another within the gap: (key, n_events, order, event_type, ts).

    Batch form. Rows that repeat ``order`` count once. Each task folds the runs of its stretch; a stretch's first and last run,
    which may go on in its neighbours, are joined afterwards, so their number is at most two per task.
    """
    micros = int(gap_seconds * 1_000_000)
    kind = dict(events.dtypes)[key]
    # Whole microseconds; a difference of seconds as floating point would not be exact.
    one = events.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("id"), "event_type", "ts").dropDuplicates(["id"])
    timed = one.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))

    def step(stretch: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the run that may still grow, as one row
        number = 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys, at = batch["key"].to_numpy(object), batch["at"].to_numpy(np.int64)
            goes_on = held is not None and held["key"].iloc[0] == keys[0] and at[0] - held["ended"].iloc[0] < micros
            starts = np.r_[True, (keys[1:] != keys[:-1]) | (at[1:] - at[:-1] >= micros)]
            begin = np.flatnonzero(starts)
            last = np.r_[begin[1:], n] - 1
            found = pd.DataFrame(
                {"stretch": stretch, "edge": False, "key": keys[begin], "number": 0, "started": at[begin], "ended": at[last], "n_events": last - begin + 1,
                 "last_id": batch["id"].to_numpy()[last], "event_type": batch["event_type"].to_numpy(object)[last], "ts": batch["ts"].to_numpy()[last]}
            )
            if goes_on:
                found.loc[0, "started"] = held["started"].iloc[0]
                found.loc[0, "n_events"] += held["n_events"].iloc[0]
            elif held is not None:
                found = pd.concat([held, found], ignore_index=True)
            found["number"] = number + np.arange(len(found))
            found["edge"] = found["number"] == 0
            number += len(found) - 1
            held = found.iloc[-1:]
            yield found.iloc[:-1]
        if held is not None:
            yield held.assign(edge=True)

    runs = scan(timed, ["key", "at", "id"], step, _RUNS)
    by_place = Window.partitionBy("key").orderBy("stretch", "number")
    opened = F.when(F.col("started") - F.lag("ended").over(by_place) < micros, 0).otherwise(1)
    edges = runs.where("edge").withColumn("opened", opened).withColumn("run", F.sum("opened").over(by_place))
    joined = edges.groupBy("key", "run").agg(F.sum("n_events").alias("n_events"), F.max(F.struct("ended", "last_id", "event_type", "ts")).alias("l"))
    whole = runs.where("NOT edge").select("key", "n_events", "last_id", "event_type", "ts").unionByName(joined.select("key", "n_events", "l.last_id", "l.event_type", "l.ts"))
    return whole.select(F.col("key").cast(kind).alias(key), "n_events", F.col("last_id").alias(order), "event_type", "ts")


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def debounce_stream(events: DataFrame, gap: str = DEBOUNCE, lateness: str = "10 minutes", key: str = "path") -> DataFrame:
    """Streaming form: a session window per path; a session is emitted when the watermark has passed its end."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap), key)
        .agg(F.count(F.lit(1)).alias("n_events"), F.max(F.struct("ts", "change_id", "event_type")).alias("last"))
        .select(key, "n_events", "last.change_id", "last.event_type", "last.ts")
    )


_CHANGES = "stretch int, is_end boolean, key string, id long, event_type string, ts timestamp_ntz, hash string, known string, told boolean"


def changed(events: DataFrame, key: str = "path", order: str = "change_id") -> DataFrame:
    """Events that tell something new: add and unlink always, change only if its hash differs from the last known one of the path.

    An unlink forgets the hash; events without a hash keep it and pass. Repeated rows count once. Each task scans its
    stretch; events before the first known hash of a key that began in an earlier stretch take it from there.
    """
    one = events.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("id"), "event_type", "ts", "hash").dropDuplicates(["id"])

    def step(stretch: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, known_now, told_now = None, None, False
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys, hashes = batch["key"].to_numpy(object), batch["hash"].to_numpy(object)
            gone = batch["event_type"].to_numpy(object) == "unlink"
            sets = gone | batch["hash"].notna().to_numpy()
            first = np.maximum.accumulate(np.where(np.r_[keys[0] != key_now, keys[1:] != keys[:-1]], np.arange(n), -1))
            setter = np.maximum.accumulate(np.where(sets, np.arange(n), -1))
            before = np.r_[-1, setter[:-1]]
            here = before >= np.maximum(first, 0)
            carried = (first < 0) & ~here
            state = np.where(gone, None, hashes)
            known = np.where(here, state[np.maximum(before, 0)], np.where(carried, known_now, None))
            told = here | carried & told_now
            yield batch[["key", "id", "event_type", "ts", "hash"]].assign(stretch=stretch, is_end=False, known=known, told=told)[_columns(_CHANGES)]
            same_key = first[-1] < 0
            ends_here = setter[-1] >= max(first[-1], 0)
            key_now, known_now, told_now = keys[-1], state[setter[-1]] if ends_here else known_now if same_key else None, bool(ends_here or same_key and told_now)
        if told_now:
            yield pd.DataFrame([(stretch, True, key_now, None, None, pd.NaT, None, known_now, True)], columns=_columns(_CHANGES))

    rows = scan(one, ["key", "ts", "id"], step, _CHANGES)
    # One row per task at most.
    ends = F.broadcast(rows.where("is_end").select(F.col("stretch").alias("from"), F.col("key").alias("k"), F.struct("known").alias("before")))
    events_only = rows.where("NOT is_end")
    open_rows = events_only.where("NOT told AND event_type = 'change' AND hash IS NOT NULL")
    settled = (
        open_rows.join(ends, (F.col("key") == F.col("k")) & (F.col("from") < F.col("stretch")), "left")
        .groupBy("key", "id", "event_type", "ts", "hash").agg(F.max_by("before", "from").alias("before"))
        .where(~F.coalesce(F.col("before.known") == F.col("hash"), F.lit(False)))
    )
    plain = events_only.where("told OR event_type <> 'change' OR event_type IS NULL OR hash IS NULL")
    fresh = plain.where(~((F.coalesce("event_type", F.lit("")) == "change") & F.coalesce(F.col("known") == F.col("hash"), F.lit(False))))
    kept = fresh.select("key", "id", "event_type", "ts", "hash").unionByName(settled.select("key", "id", "event_type", "ts", "hash"))
    return kept.select(F.col("key").alias(key), F.col("id").alias(order), "event_type", "ts", "hash")


def changed_stream(events: DataFrame, key: str = "path") -> DataFrame:
    """Streaming form with the last hash of each path as state; an unlink clears it. Needs the RocksDB state store."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        known = state.get[0] if state.exists else None
        for frame in frames:
            rows = frame.sort_values(["ts", "change_id"], kind="stable")
            hashes = rows["hash"].to_numpy(object)
            gone = rows["event_type"].to_numpy(object) == "unlink"
            sets = gone | rows["hash"].notna().to_numpy()
            values = np.where(gone, None, hashes)
            setter = np.maximum.accumulate(np.where(sets, np.arange(len(rows)), -1))
            before = np.r_[-1, setter[:-1]][: len(rows)]
            last = np.where(before >= 0, values[np.maximum(before, 0)], known)
            same = (rows["event_type"].to_numpy(object) == "change") & rows["hash"].notna().to_numpy() & (hashes == last)
            if len(rows) and setter[-1] >= 0:
                known = values[setter[-1]]
            yield rows.loc[~same, ["change_id", "event_type", "ts", "hash"]].assign(**{key: group[0]})[[key, "change_id", "event_type", "ts", "hash"]]
        if known is None:
            if state.exists:
                state.remove()
        else:
            state.update((known,))

    typed = events.select(key, "change_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "hash")
    return typed.groupBy(key).applyInPandasWithState(step, f"{key} string, change_id long, event_type string, ts timestamp, hash string", "hash string", "append", "NoTimeout")


def moves(events: DataFrame) -> DataFrame:
    """A move (ts, source, target) becomes an unlink of the source and an add of the target."""
    pair = F.array(F.struct(F.col("source").alias("path"), F.lit("unlink").alias("event_type")), F.struct(F.col("target").alias("path"), F.lit("add").alias("event_type")))
    return events.select("ts", F.inline(pair))


def enrich(events: DataFrame) -> DataFrame:
    """Adds the language of the path, the size of the content and its SHA-256; null where there is no content."""
    from lodestrata.functions.languages import detect_language

    return events.withColumns({"language": detect_language(F.col("path")), "size": F.octet_length("content").cast("long"), "hash": F.sha2("content", 256)})


def read_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def write_log(frame: DataFrame, folder: str) -> None:
    """Append calls as JSON lines."""
    frame.write.mode("append").json(folder)


def upsert_batches(table_path: str, key: str = "path"):  # noqa: ANN201
    """A sink for foreachBatch that keeps the newest row of each key in a parquet folder; a repeated batch changes nothing.

    Each batch writes a folder of its own, and the current one is named in a file that is replaced at the end, so a
    reader never sees half a batch.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(table_path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = [int(s.getPath().getName()) for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getPath().getName().isdigit() and fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
        if batch_id in done:
            return
        rows = batch
        if done:
            rows = spark.read.parquet(f"{table_path}/{max(done)}").unionByName(batch)
        latest_per_key(rows, [key], [F.col("ts"), F.col("change_id")]).write.mode("overwrite").parquet(f"{table_path}/{batch_id}")

    return sink
