from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestrata.streaming import changes

SCHEMA = "change_id long, path string, event_type string, ts timestamp_ntz, hash string"
T0 = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, p, t, T0 + timedelta(milliseconds=ms), h) for i, p, t, ms, h in rows], SCHEMA)


ROWS = [(1, "a", "add", 0, "h1"), (2, "a", "change", 100, "h1"), (3, "a", "change", 700, "h2"), (4, "a", "unlink", 2000, None), (5, "a", "change", 3000, "h2"), (6, "b", "change", 0, None), (7, "b", "change", 100, None), (1, "a", "add", 0, "h1")]


def test_debounce(spark):
    got = {(r.path, r.change_id, r.n_events) for r in changes.debounce(events(spark, ROWS)).collect()}
    assert got == {("a", 2, 2), ("a", 3, 1), ("a", 4, 1), ("a", 5, 1), ("b", 7, 2)}


def test_content_changes(spark):
    assert {r.change_id for r in changes.changed(events(spark, ROWS)).collect()} == {1, 3, 4, 5, 6, 7}
    assert changes.changed(events(spark, ROWS).limit(0)).count() == 0


def test_hot_path_spread_over_tasks(spark):
    rows = [(i, "hot", ["add", "change", "change", "unlink"][i % 4] if i % 7 else "change", i * 130 + (i // 5) * 600, f"h{i // 3 % 4}" if i % 6 else None) for i in range(500)]
    known, fresh, runs = None, set(), []
    for i, _, kind, ms, h in rows:
        if not (kind == "change" and h is not None and h == known):
            fresh.add(i)
        known = None if kind == "unlink" else h if h is not None else known
        if runs and ms - runs[-1][1] < 500:
            runs[-1] = (runs[-1][0] + 1, ms, i)
        else:
            runs.append((1, ms, i))
    frame = events(spark, rows)
    assert {r.change_id for r in changes.changed(frame).collect()} == fresh
    assert {(r.n_events, r.change_id) for r in changes.debounce(frame).collect()} == {(n, i) for n, _, i in runs}


def test_streams_equal_their_batch_forms(spark, tmp_path):
    events(spark, ROWS).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = changes.changed_stream(source.withColumn("ts", F.col("ts").cast("timestamp")).dropDuplicates(["change_id"])).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.change_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 3, 4, 5, 6, 7}


def test_upsert_sink_survives_repeated_batches(spark, tmp_path):
    sink = changes.upsert_batches(str(tmp_path / "t"))
    first, second = events(spark, ROWS[:2]), events(spark, ROWS[2:6])
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        sink(batch, number)
    rows = spark.read.parquet(str(tmp_path / "t" / "1")).collect()
    assert {(r.path, r.change_id) for r in rows} == {("a", 5), ("b", 6)}


def test_filters_moves_and_log(spark, tmp_path):
    p = spark.createDataFrame([("src/a.py",), ("node_modules/x.js",), ("b.log.txt",), ("c.md",)], "path string")
    assert [r.path for r in p.where(~changes.should_ignore(F.col("path"), ["node_modules/**", "*.log"]) & changes.matches(F.col("path"), ["*.py", "?.md"])).collect()] == ["src/a.py", "c.md"]
    m = spark.createDataFrame([(T0, "a", "b")], "ts timestamp_ntz, source string, target string")
    assert {(r.path, r.event_type) for r in changes.moves(m).collect()} == {("a", "unlink"), ("b", "add")}
    for _ in range(2):
        changes.write_log(m, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
