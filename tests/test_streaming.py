"""Streams over several landed files, against the batch result."""

import datetime as dt
import random

from pyspark.sql import functions as F

from corpusweave.session import new_table_path
from corpusweave.streaming import jobs

SCHEMA = "key string, seq long, value string, ts timestamp, failed boolean"


def land(spark, files):
    path = new_table_path(spark, "landed")
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def row(key, seq, minute, failed=False):
    return (key, seq, f"{key}{seq}", dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=minute), failed)


def test_ingest_over_several_batches(spark):
    files = [[row("a", 1, 0), row("b", 2, 0), row("a", 3, 0)], [row("b", 4, 1), row("c", 5, 1)], [row("a", 0, 2)]]
    out = jobs.ingest_catalogue(spark, land(spark, files).drop("ts", "failed"), "key", "seq", new_table_path(spark, "ingest"), new_table_path(spark, "checkpoint"))
    assert {(r.key, r.value) for r in out.collect()} == {("a", "a3"), ("b", "b4"), ("c", "c5")}


def test_budget_is_updated_across_batches(spark):
    files = [[row("x", i, i % 10, failed=i % 2 == 0) for i in range(60)], [row("x", i, i % 10, failed=True) for i in range(60)]]
    out = jobs.live_budget(spark, land(spark, files), "ts", "failed", "1 hour", "1 hour", new_table_path(spark, "budget"), new_table_path(spark, "checkpoint"))
    (only,) = out.collect()
    assert (only.files, only.fails, only.exceeded) == (120, 90, True)


def test_repeated_batches_are_dropped(spark):
    files = [[row("a", 1, 0), row("b", 1, 5)], [row("a", 1, 6), row("c", 1, 7)]]
    path = new_table_path(spark, "dedup")
    jobs.run_available(jobs.without_repeats(land(spark, files), ["key"], "ts", "1 hour"), "append", jobs.batch_table_sink(path), new_table_path(spark, "checkpoint"))
    assert sorted(r.key for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_late_rows_are_counted(spark):
    files = [[row("a", 1, 600)], [row("b", 1, 601)], [row("c", 1, 0)]]
    path = new_table_path(spark, "late")
    late = jobs.run_available(jobs.without_repeats(land(spark, files), ["key"], "ts", "1 hour"), "append", jobs.batch_table_sink(path), new_table_path(spark, "checkpoint"))
    assert sorted(r.key for r in spark.read.parquet(path).collect()) == ["a", "b"]
    assert late == 1


def test_silences_close_sessions(spark):
    files = [[row("a", 1, 0), row("a", 2, 5)], [row("a", 3, 60)], [row("b", 1, 600)]]
    path = new_table_path(spark, "sessions")
    jobs.run_available(jobs.silences(land(spark, files), F.col("key"), "ts", "10 minutes", "1 minute"), "append", jobs.batch_table_sink(path), new_table_path(spark, "checkpoint"))
    assert sorted((r.source, r.events) for r in spark.read.parquet(path).collect()) == [("a", 1), ("a", 2)]


def test_a_second_run_takes_new_files_only(spark):
    path, table, checkpoint = (new_table_path(spark, n) for n in ("landed", "ingest", "checkpoint"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(path).drop("ts", "failed")

    def land_one(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)

    spark.createDataFrame([], SCHEMA).write.parquet(path)  # a source without rows yet
    assert jobs.ingest_catalogue(spark, stream(), "key", "seq", table, checkpoint).count() == 0
    land_one(row("a", 1, 0), row("b", 2, 0))
    jobs.ingest_catalogue(spark, stream(), "key", "seq", table, checkpoint)
    land_one(row("a", 3, 1))
    out = jobs.ingest_catalogue(spark, stream(), "key", "seq", table, checkpoint)
    assert {(r.key, r.value) for r in out.collect()} == {("a", "a3"), ("b", "b2")}
    first, again, second = sorted(r.generation for r in spark.read.parquet(f"{table}/data").select("key", "generation").collect())
    assert first == again < second, "a file was taken twice, or a bucket written without need"


def test_late_rows_of_a_long_run_are_all_counted(spark):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    files = [[row("a", 1, 600)], [row("b", 1, 601)], *[[row(f"c{i}", 1, i)] for i in range(4)]]
    path = new_table_path(spark, "late")
    late = jobs.run_available(jobs.without_repeats(land(spark, files), ["key"], "ts", "1 hour"), "append", jobs.batch_table_sink(path), new_table_path(spark, "checkpoint"))
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert late == 4


def test_page_budget_of_a_stream(spark):
    files = [[row("x", i, i % 10, failed=i % 10 == 0) for i in range(40)], [row("x", i, i % 10, failed=True) for i in range(3)]]
    out = jobs.live_page_budget(spark, land(spark, files), "failed", new_table_path(spark, "pages"), new_table_path(spark, "checkpoint"))
    assert tuple(out.first()) == (43, 7, 5, True)


def test_a_run_reads_and_writes_only_buckets_that_it_touches(spark, monkeypatch):
    path, table, checkpoint = (new_table_path(spark, n) for n in ("landed", "merge", "checkpoint"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(path).drop("ts", "failed")
    draw = random.Random(2)
    want, seq = {}, 0
    for run, keys in enumerate([[f"k{i}" for i in range(60)] * 3, ["k1", "k2"], ["k1", "new"], ["k7"]]):
        rows = []
        for key in keys:
            seq += 1
            rows.append(row(key, seq, 0))
            want[key] = f"{key}{seq}"
        draw.shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        read = []
        held = jobs.best_per_key
        monkeypatch.setattr(jobs, "best_per_key", lambda df, *a: (read.append(df.count()), held(df, *a))[1])
        out = jobs.ingest_catalogue(spark, stream(), "key", "seq", table, checkpoint, buckets=8)
        monkeypatch.setattr(jobs, "best_per_key", held)
        assert {r.key: r.value for r in out.collect()} == want
        written = spark.read.parquet(f"{table}/data").filter(F.col("generation") == run)
        assert written.select("bucket").distinct().count() == (8 if run == 0 else len({bucket_of(spark, k) for k in keys}))
        if run == 3:  # one bucket out of eight
            assert max(read) == written.count() + 1 < 20


def bucket_of(spark, key):
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(key)), F.lit(8))).first()[0]


def test_a_batch_that_is_run_again_changes_nothing(spark):
    table = new_table_path(spark, "merge")
    sink = jobs.merge_sink(table, "key", "seq", 4)
    frame = lambda *rows: spark.createDataFrame(rows, SCHEMA).drop("ts", "failed")
    sink(frame(row("a", 1, 0), row("b", 2, 0)), 0)
    for _ in range(2):
        sink(frame(row("a", 5, 0), row("c", 3, 0)), 1)
    out = jobs.merged(spark, table, frame(row("a", 1, 0)))
    assert sorted((r.key, r.value) for r in out.collect()) == [("a", "a5"), ("b", "b2"), ("c", "c3")]
    assert jobs.merged(spark, new_table_path(spark, "none"), frame(row("a", 1, 0))).count() == 0


def test_a_cursor_is_known_after_any_time_and_after_a_restart(spark, monkeypatch):
    monkeypatch.setattr(jobs, "leading_bits", lambda n: 15)  # a small map, so that new cursors look like old ones
    path, table, checkpoint = (new_table_path(spark, n) for n in ("landed", "guard", "checkpoint"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)

    def land_one(keys, minute):
        spark.createDataFrame([row(k, 1, minute) for k in keys] + [(None, 1, "x", None, False)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        return {r.key: r.repeats for r in jobs.repeated_keys(spark, stream(), ["key"], table, checkpoint).collect()}

    many = [f"c{i}" for i in range(3000)]
    assert land_one(["first", *many], 0) == {}
    assert land_one([f"d{i}" for i in range(3000)], 60 * 24 * 400) == {}
    assert land_one(["first", "second", "second"], 60 * 24 * 900) == {"first": 1, "second": 1}
    assert land_one(["second", "first", "d5"], 3) == {"first": 2, "second": 2, "d5": 1}


def test_a_source_that_stops_is_reported_while_others_go_on(spark):
    """Two sources; one falls silent after the first file, the other one goes on for longer than the patience. Nothing more comes from the silent one."""
    path, out = new_table_path(spark, "landed"), new_table_path(spark, "alarms")
    spark.createDataFrame([row("stops", 1, 0), row("stops", 2, 7), row("goes on", 1, 0)], SCHEMA).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    alarms = jobs.silence_alarms(stream, F.col("key"), "ts", 4000)
    heard = {}

    def sink(batch, number):
        for r in batch.collect():
            heard[r.source] = (r.last, r.events)
        jobs.batch_table_sink(out)(batch, number)

    query = alarms.writeStream.foreachBatch(sink).option("checkpointLocation", new_table_path(spark, "checkpoint")).trigger(processingTime="500 milliseconds").start()
    try:
        for n in range(40):
            spark.createDataFrame([row("goes on", n, 100 + n)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
            if query.awaitTermination(1) or heard:
                break
    finally:
        query.stop()
    assert heard == {"stops": (dt.datetime(2024, 1, 1, 10, 7), 2)}


def test_alarms_of_a_log_that_ends(spark):
    path, out = new_table_path(spark, "landed"), new_table_path(spark, "alarms")
    spark.createDataFrame([row("a", i, i) for i in range(5)] + [row("b", 1, 3), (None, 1, "x", dt.datetime(2024, 1, 1), True)], SCHEMA).coalesce(1).write.parquet(path)
    alarms = jobs.silence_alarms(spark.readStream.schema(SCHEMA).parquet(path), F.col("key"), "ts", 500)
    jobs.run_until_silent(alarms, jobs.batch_table_sink(out), new_table_path(spark, "checkpoint"), "300 milliseconds", 60)
    assert sorted((r.source, r.last.minute, r.events) for r in spark.read.parquet(out).collect()) == [("a", 4, 5), ("b", 3, 1)]
