"""Streams over landed batches. State is bounded by watermarks or kept in tables, never in the driver.

Each sink writes one folder per micro-batch, overwriting it if the batch is run again after a failure, so
results are exactly-once; readers merge the folders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from threading import Event
from time import monotonic

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusweave.operators.quality import files_over_budget, pages_over_budget
from corpusweave.plans.bitmaps import bit_is_set, bit_map, leading_bits, part_of
from corpusweave.plans.keyed import best_per_key
from corpusweave.session import cut, small_table


def batch_table_sink(path: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


class LateRows(StreamingQueryListener):
    """Counts, over a whole run, the rows that a stream drops because they came after the watermark."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.ended: dict[str, Event] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        run = str(event.progress.runId)
        self.dropped[run] = self.dropped.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.setdefault(str(event.runId), Event()).set()

    def of(self, run: str) -> int:
        """The count of a run that has ended; listeners are told a little later than the caller."""
        self.ended.setdefault(run, Event()).wait(30)
        return self.dropped.get(run, 0)


def run_available(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Process what has landed since the last run with this checkpoint, then stop; returns the rows that came too late.

    ``checkpoint`` is a folder that all runs of the stream share and no other stream uses; files that a run has taken are not taken again.
    """
    spark, late = stream.sparkSession, LateRows()
    spark.streams.addListener(late)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return late.of(str(query.runId))
    finally:
        spark.streams.removeListener(late)


def written(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What the runs of a sink have written, with its batch; nothing yet is an empty table."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # no batch has been written
        return spark.createDataFrame([], StructType([*like.schema.fields, StructField("batch", IntegerType())]))


def merged(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of a merge table as of its last committed generation; nothing yet is an empty table."""
    current = generations(spark, path)
    if not current:
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(*(f"{path}/data/bucket={bucket}/generation={g}" for bucket, g in sorted(current.items())))


def generations(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Bucket -> generation that holds its rows, by the last manifest (before a given generation): as many rows as there are buckets."""
    try:
        manifests = spark.read.parquet(f"{path}/manifest")
    except AnalysisException:  # nothing is committed
        return {}
    if before is not None:
        manifests = manifests.filter(F.col("at") < before)
    return {r["bucket"]: r["generation"] for r in manifests.groupBy("bucket").agg(F.max("generation").alias("generation")).collect()}


def merge_sink(path: str, key: str, seq: str, buckets: int) -> Callable[[DataFrame, int], None]:
    """Upserts a micro-batch into a merge table: ``data/bucket=b/generation=g`` and one manifest for each generation.

    Only buckets that the batch touches are read and written, as a new generation; the manifest, written last, commits it by naming the generation of each of
    them. A batch that is run again after a failure starts from the manifests before it and overwrites its own generation.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
        changes = cut(best_per_key(batch, [key], F.col(seq)).select("*", bucket))
        touched = sorted(r["bucket"] for r in changes.select("bucket").distinct().collect())  # at most ``buckets``
        if not touched:
            return
        current = generations(spark, path, batch_id)
        folders = [f"{path}/data/bucket={b}/generation={current[b]}" for b in touched if b in current]
        held = spark.read.schema(batch.schema).parquet(*folders).select("*", bucket).union(changes.select(*batch.columns, "bucket")) if folders else changes
        rows = best_per_key(held, [key, "bucket"], F.col(seq)).select(*batch.columns, "bucket", F.lit(batch_id).alias("generation"))
        rows.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "generation").parquet(f"{path}/data")
        manifest = small_table(spark, ["bucket", "generation"], [(b, batch_id) for b in touched])
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/at={batch_id}")

    return write


def ingest_catalogue(spark: SparkSession, stream: DataFrame, key: str, seq: str, path: str, checkpoint: str, buckets: int = 16) -> DataFrame:
    """Upsert landed changes by key into the merge table under ``path``; a later run with the same ``path`` and ``checkpoint`` goes on where this one ended.

    The cost of a run follows what has landed since the last one, as long as it touches few of the ``buckets``: choose so many that one of them is some hundred MB.
    """
    run_available(stream, "append", merge_sink(path, key, seq, buckets), checkpoint)
    return merged(spark, path, stream)


def live_budget(spark: SparkSession, stream: DataFrame, time: str, failed: str, window: str, late: str, path: str, checkpoint: str) -> DataFrame:
    """Files, failures and the budget check per time window, updated while the stream runs: start, files, fails, exceeded."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(failed).alias("fails"))
    rows = counts.select(F.col("window.start").alias("start"), "files", "fails", files_over_budget(F.col("files"), F.col("fails")).alias("exceeded"))
    run_available(rows, "update", batch_table_sink(path), checkpoint)
    return best_per_key(written(spark, path, rows), ["start"], F.col("batch")).drop("batch")


def live_page_budget(spark: SparkSession, stream: DataFrame, hard: str, path: str, checkpoint: str) -> DataFrame:
    """Pages so far, how many failed hard, how many may, and whether the run must end: one row, renewed with each micro-batch."""
    rows = pages_over_budget(stream.groupBy().agg(F.count(F.lit(1)).alias("pages"), F.count_if(hard).alias("hard")))
    run_available(rows, "update", batch_table_sink(path), checkpoint)
    return written(spark, path, rows).orderBy(F.desc("batch")).limit(1).drop("batch")


def without_repeats(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Drop repeated batches: a key seen again within the watermark is the same batch. Later rows are dropped by Spark and
    counted by ``run_available``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def silences(stream: DataFrame, source: Column, time: str, gap: str, late: str) -> DataFrame:
    """Activity sessions per source as they close; the streaming twin of ``quality.silence_sessions``."""
    sessions = stream.withWatermark(time, late).groupBy(source.alias("source"), F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("events"))
    return sessions.select("source", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


# --- repeated cursors, at any distance -----------------------------------------------------------------

def guard_sink(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Counts how often each key of a micro-batch has been met again, however long ago it came first.

    ``new/batch=b`` has the keys that batch b was the first to bring, ``maps/batch=b`` a bit map of them, ``repeats/batch=b`` the keys it met again. A
    batch is held against the bit maps, which are small; only keys that one of them lets pass are joined with the keys of those batches, so a key
    that only looks like an earlier one is found to be new. Nothing is forgotten, and history isn't read for keys that are new.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = F.xxhash64(*keys)
        met = cut(batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).select("*", name.alias("name")))
        fields = met.schema
        maps = written(spark, f"{path}/maps", spark.createDataFrame([], "part long, bits binary, power int")).filter(F.col("batch") < batch_id)
        powers = {r["power"] for r in maps.select("power").distinct().collect()}  # one for each power of two of a batch's size
        maybe = [met.withColumn("part", part_of("name", p)).join(maps.filter(F.col("power") == p), "part").filter(bit_is_set("bits", "name", p)).select("name", "batch") for p in sorted(powers)]
        suspects = cut(reduce(DataFrame.union, maybe)) if maybe else None
        earlier = None
        if suspects is not None and not suspects.isEmpty():
            asked = sorted(r["batch"] for r in suspects.select("batch").distinct().collect())
            history = spark.read.parquet(f"{path}/new").filter(F.col("batch").isin(asked))
            earlier = cut(history.join(suspects.select("name").distinct(), "name", "left_semi").select(*keys).distinct())
        known = met.join(earlier, list(keys), "left_semi") if earlier is not None else spark.createDataFrame([], fields)
        fresh = met.join(earlier, list(keys), "left_anti") if earlier is not None else met
        again = known.select(*keys, F.col("times").alias("repeats")).union(fresh.filter("times > 1").select(*keys, F.col("times") - 1))
        again.write.mode("overwrite").parquet(f"{path}/repeats/batch={batch_id}")
        fresh = cut(fresh.select(*keys, "name"))
        fresh.write.mode("overwrite").parquet(f"{path}/new/batch={batch_id}")
        power = leading_bits(fresh.count())
        bit_map(fresh.select("name"), power).withColumn("power", F.lit(power)).write.mode("overwrite").parquet(f"{path}/maps/batch={batch_id}")

    return write


def repeated_keys(spark: SparkSession, stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """``keys``, repeats: keys that all runs with this ``path`` and ``checkpoint`` have met again, and how often; null keys are no cursors."""
    stream = stream.select(*keys).dropna()
    run_available(stream, "append", guard_sink(path, keys), checkpoint)
    like = stream.withColumn("repeats", F.lit(0).cast("long"))
    return written(spark, f"{path}/repeats", like).groupBy(*keys).agg(F.sum("repeats").alias("repeats"))


# --- alarms ----------------------------------------------------------------------------------------

ALARM = "source string, last timestamp, events long"


def silence_alarms(stream: DataFrame, source: Column, time: str, patience_ms: int) -> DataFrame:
    """source, last, events: one row for each source as soon as it has been silent for ``patience_ms`` by the clock, whether anything else arrives or not.

    State is one row for each source that isn't silent: its last event and how many there were since its last alarm. An event sets the source's timer
    anew; when it runs out, the alarm is given and the source forgotten until it speaks again.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, events = state.get
            state.remove()
            yield pd.DataFrame({"source": [key[0]], "last": [pd.Timestamp(last, unit="us")], "events": [events]})
            return
        last, events = state.get if state.exists else (-(1 << 62), 0)
        for rows in batches:
            last, events = max(last, int(rows["micros"].max())), events + len(rows)
        state.update((last, events))
        state.setTimeoutDuration(patience_ms)

    told = stream.select(source.cast("string").alias("source"), F.unix_micros(time).alias("micros")).dropna()
    return told.groupBy("source").applyInPandasWithState(watch, ALARM, "last long, events long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_until_silent(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", most_seconds: float = 600) -> None:
    """Run a stream of alarms until no source is watched any more: all that landed has been read and every source has been reported."""
    query = stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    until, begun = monotonic() + most_seconds, False
    try:
        while monotonic() < until and not query.awaitTermination(1):
            progress = query.lastProgress
            if progress is None:
                continue
            watched = sum(op["numRowsTotal"] for op in progress["stateOperators"])
            begun = begun or watched > 0 or progress["numInputRows"] > 0
            if begun and watched == 0 and progress["numInputRows"] == 0:
                return
    finally:
        query.stop()
