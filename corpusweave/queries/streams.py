"""Streaming queries: finite runs over the landed event file."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusweave.queries import Family
from corpusweave.session import new_table_path
from corpusweave.sources import views
from corpusweave.streaming import jobs

QUERIES = Family()


def _stream(spark, sf_dir):
    schema = views.table(spark, sf_dir, "events").schema
    landed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    # watermarks need a timestamp with a zone; the landed one has none and is taken as UTC
    return landed.withColumn("ts", F.col("ts").cast("timestamp"))


@QUERIES.add("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def stream_ingest(spark, sf_dir):
    changes = _stream(spark, sf_dir).select("user_id", "event_id", "event_type", "value")
    return jobs.ingest_catalogue(spark, changes, "user_id", "event_id", new_table_path(spark, "ingest"), new_table_path(spark, "ingest-checkpoint"))


@QUERIES.add("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS files, count(*) FILTER (event_type = 'error') AS fails,
  count(*) FILTER (event_type = 'error') > 50 AND count(*) FILTER (event_type = 'error') * 10000.0 / count(*) > 10 AS exceeded FROM events GROUP BY 1""")
def stream_budget(spark, sf_dir):
    log = _stream(spark, sf_dir).select("ts", (F.col("event_type") == "error").alias("failed"))
    windows = jobs.live_budget(spark, log, "ts", "failed", "1 day", "1 day", new_table_path(spark, "budget"), new_table_path(spark, "budget-checkpoint"))
    return windows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "files", "fails", "exceeded")


@QUERIES.add("SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d %H') AS hour FROM events")
def stream_dedup(spark, sf_dir):
    # repeats of a cursor lie within one hour, so an hour of watermark catches every one
    cursors = _stream(spark, sf_dir).select("user_id", "ts", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))
    path = new_table_path(spark, "cursors")
    stream = jobs.without_repeats(cursors, ["user_id", "hour"], "ts", "1 hour")
    jobs.run_available(stream, "append", jobs.batch_table_sink(path), new_table_path(spark, "cursors-checkpoint"))
    return spark.read.parquet(path).select("user_id", "hour")


@QUERIES.add("""
SELECT count(*) AS pages, count(*) FILTER (event_type = 'error' AND event_id % 50 = 0) AS hard, greatest(5, count(*) // 100000) AS allowed,
  count(*) FILTER (event_type = 'error' AND event_id % 50 = 0) > greatest(5, count(*) // 100000) AS exceeded FROM events""")
def stream_page_budget(spark, sf_dir):
    log = _stream(spark, sf_dir).select(((F.col("event_type") == "error") & (F.col("event_id") % 50 == 0)).alias("hard"))
    return jobs.live_page_budget(spark, log, "hard", new_table_path(spark, "pages"), new_table_path(spark, "pages-checkpoint"))


# a session is given out when the watermark has passed its end; the last one of a user may still be open
@QUERIES.add("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e),
g AS (SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS events FROM s GROUP BY user_id, session)
SELECT user_id AS source, strftime(first, '%Y-%m-%d %H:%M:%S') AS start, events FROM g WHERE last + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)""")
def stream_stalls(spark, sf_dir):
    path = new_table_path(spark, "stalls")
    stream = jobs.silences(_stream(spark, sf_dir), F.col("user_id"), "ts", "6 hours", "0 seconds")
    jobs.run_available(stream, "append", jobs.batch_table_sink(path), new_table_path(spark, "stalls-checkpoint"))
    return spark.read.parquet(path).select("source", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


@QUERIES.add("SELECT user_id, event_type, count(*) - 1 AS repeats FROM events GROUP BY user_id, event_type HAVING count(*) > 1")
def cursor_guard(spark, sf_dir):
    # the log lands in several pieces, each a batch; a cursor may come again any number of batches later
    landed, schema = new_table_path(spark, "landed-cursors"), "user_id long, event_type string"
    views.table(spark, sf_dir, "events").select("user_id", "event_type").repartition(4, "user_id", F.col("event_id") % 7).write.parquet(landed)
    pieces = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed)
    return jobs.repeated_keys(spark, pieces, ["user_id", "event_type"], new_table_path(spark, "guard"), new_table_path(spark, "guard-checkpoint"))


@QUERIES.add("SELECT CAST(user_id AS VARCHAR) AS source, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS events FROM events GROUP BY user_id")
def silence_alarms(spark, sf_dir):
    # the log ends, so that every source falls silent; no later event is needed to tell
    path = new_table_path(spark, "alarms")
    alarms = jobs.silence_alarms(_stream(spark, sf_dir), F.col("user_id"), "ts", 2000)
    jobs.run_until_silent(alarms, jobs.batch_table_sink(path), new_table_path(spark, "alarms-checkpoint"))
    return spark.read.parquet(path).select("source", F.date_format("last", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last"), "events")
