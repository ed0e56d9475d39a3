"""Incremental processing of files in levels: skip what is up to date, reuse levels that succeeded, stop at the first failure, retry later."""

from __future__ import annotations

import logging
import time as clock
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import backoff
from ..operators.nested import ast_error, domain_error
from ..sources.store import FileStore

REQUIRED = ["Ast", "DomainKeywords"]
ATTEMPTS, DELAY_S = 3, 5.0
CHECKS = {"Ast": ast_error, "DomainKeywords": domain_error}
#: content -> JSON for each level; stands where a model would.
Extractor = Callable[[pd.Series], pd.Series]


def required_levels(files: DataFrame, levels: list[str] = REQUIRED) -> DataFrame:
    """A row for each file and level, in order."""
    return files.withColumn("level", F.explode(F.array(*map(F.lit, levels))))


def process(files: DataFrame, store: FileStore, extractors: dict[str, Extractor], now, levels: list[str] = REQUIRED) -> DataFrame:
    """Entries for the files (file_path, file_hash, file_size, last_modified, content) that are not up to date.

    Levels that an entry of the same hash has, and that succeeded, are taken over. A level after one that failed is not run.
    """
    old = store.read().select("file_path", F.col("file_hash").alias("old_hash"), F.col("status").alias("old_status"), F.col("level_data").alias("old"))
    out = files.join(old, "file_path", "left")
    same = F.coalesce(F.col("old_hash") == F.col("file_hash"), F.lit(False))
    out = out.filter(~(same & (F.col("old_status") == "Completed")))
    going = F.lit(True)
    results = []
    for level in levels:
        run = F.pandas_udf(extractors[level], T.StringType())
        kept = F.when(same, F.col("old")[level])
        reuse = F.coalesce(kept["is_success"], F.lit(False))
        out = out.withColumn(f"_{level}", F.when(going & ~reuse, run(F.col("content"))))
        error = CHECKS[level](F.col(f"_{level}")) if level in CHECKS else F.when(F.col(f"_{level}").isNull(), "no result")
        out = out.withColumn(f"_{level}_error", F.when(going & ~reuse, error))
        ok = reuse | F.col(f"_{level}_error").isNull()
        new = F.struct(F.col(f"_{level}").alias("content"), F.lit(now).cast("timestamp").alias("processed_at"), F.lit(0.0).alias("duration_s"), ok.alias("is_success"), F.col(f"_{level}_error").alias("error_message"))
        value = F.when(going & reuse, kept).when(going, new)
        out = out.withColumn(f"_{level}_value", value).withColumn(f"_{level}_ok", going & ok)
        results.append(F.struct(F.lit(level).alias("key"), F.col(f"_{level}_value").alias("value")))
        going = F.col(f"_{level}_ok")
    data = F.map_from_entries(F.filter(F.array(*results), lambda x: x["value"].isNotNull()))
    return out.select(
        "file_path", "file_hash", F.lit(now).cast("timestamp").alias("processed_at"), "last_modified", "file_size", F.when(going, "Completed").otherwise("Failed").alias("status"), data.alias("level_data")
    )


def job_results(entries: DataFrame) -> DataFrame:
    """file_path and result: one JSON text of an entry's levels, their results, and their seconds together."""
    one = F.transform_values("level_data", lambda _, v: F.struct(v["is_success"].alias("Success"), v["content"].alias("Content"), v["duration_s"].alias("ProcessingDuration"), v["processed_at"].alias("ProcessedAt")))
    seconds = F.aggregate(F.map_values("level_data"), F.lit(0.0), lambda a, v: a + F.coalesce(v["duration_s"], F.lit(0.0)))
    body = F.struct(F.col("file_path").alias("FilePath"), F.map_keys("level_data").alias("ProcessedLevels"), one.alias("Results"), seconds.alias("TotalDuration"))
    return entries.select("file_path", F.to_json(body, {"pretty": "true"}).alias("result"))


def start(stream: DataFrame, store: FileStore, extractors: dict[str, Extractor], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Processes each micro-batch of a stream of files and merges it into the store."""

    def merge(batch: DataFrame, _: int) -> None:
        now = batch.sparkSession.sql("select current_timestamp()").first()[0]
        store.upsert(process(batch, store, extractors, now))

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def capacity(workers: int = 3) -> int:
    """How many files wait at most for so many workers. The numbers are fixed values."""
    return max(100 * workers, 1000)


def intake(spark: SparkSession, schema: T.StructType, path: str, workers: int = 3) -> DataFrame:
    """A stream of a folder's Parquet files that admits no more than capacity() of them at a time; others wait where they lie."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", capacity(workers)).parquet(path)


def progress(run: StreamingQuery) -> dict:
    """Of a stream's recent batches: how many there were, the rows that they took, and the rows a second of the last; and whether it runs."""
    recent = run.recentProgress
    return {"active": run.isActive, "batches": len(recent), "rows": sum(p["numInputRows"] for p in recent), "rows_per_s": recent[-1]["processedRowsPerSecond"] if recent else 0.0}


def monitor(run: StreamingQuery, report: Callable[[dict], None], every_s: float = 30.0) -> None:
    """Reports a stream's progress at such times until it ends, and once then. An error that ended it is raised."""
    while not run.awaitTermination(every_s):
        report(progress(run))
    report(progress(run))


def shut_down(run: StreamingQuery, drain_s: float = 30.0) -> dict:
    """Ends a stream in phases: what has come is worked on for so many seconds at most, then it is stopped. Its progress, and whether nothing was left.

    A batch that was cut short is not lost: it is run again from the checkpoint when the stream is started anew.
    """
    until, drained = clock.monotonic() + drain_s, False
    while run.isActive and not drained and clock.monotonic() < until:
        status = run.status
        drained = not status["isDataAvailable"] and not status["isTriggerActive"] and run.lastProgress is not None
        if not drained:
            clock.sleep(0.1)
    drained = drained or not run.isActive
    last = progress(run)
    run.stop()
    return {**last, "active": run.isActive, "drained": drained}


def call_back(steps: DataFrame, callbacks: dict[str, list[Callable[[DataFrame], None]]], failed: Callable[[str, Exception], None] | None = None) -> None:
    """Hands the steps of each type to the callbacks of that type, in order: for foreachBatch of a stream of steps.

    A callback that fails is reported (logged by default), and stops neither the others nor the stream.
    """
    report = failed or (lambda kind, error: logging.getLogger(__name__).warning("callback for %s: %s", kind, error))
    for kind, each in callbacks.items():
        of_kind = steps.filter(F.col("step_type") == kind)
        for callback in each:
            try:
                callback(of_kind)
            except Exception as error:  # noqa: BLE001
                report(kind, error)


# jobs: job_id, worker_id, status, created_at, duration_s, attempt


def claim(jobs: DataFrame, active: DataFrame, key: str = "file_path") -> DataFrame:
    """Pending jobs to work on now, as Processing: the oldest of each key that no active job has."""
    first = F.min_by(F.struct(*jobs.columns), F.struct("created_at", "job_id")).alias("j")
    waiting = jobs.filter("status = 'Pending'").join(active.select(key).distinct(), key, "left_anti")
    return waiting.groupBy(F.col(key).alias("_key")).agg(first).select("j.*").withColumn("status", F.lit("Processing"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter("status = 'Processing'")


def queue_length(jobs: DataFrame) -> DataFrame:
    """One row: the jobs that wait, retries included."""
    return jobs.agg(F.count_if(F.col("status").isin("Pending", "Retrying")).alias("length"))


def queue_statistics(jobs: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    mean = F.coalesce(F.avg(F.when(F.col("status") == "Completed", F.col("duration_s"))), F.lit(0.0))
    return jobs.agg(n("Pending").alias("pending"), n("Processing").alias("active"), n("Completed").alias("completed"), n("Failed").alias("failed"), mean.alias("avg_duration_s"))


def retries(jobs: DataFrame, attempts: int = ATTEMPTS, delay: float = DELAY_S) -> DataFrame:
    """Failed jobs with next_attempt, the seconds to wait, or Failed for good after so many attempts."""
    again = (F.col("status") == "Failed") & (F.col("attempt") < attempts)
    out = jobs.withColumn("next_status", F.when(again, "Retrying").otherwise(F.col("status")))
    return out.withColumn("wait_s", F.when(again, backoff(delay, F.col("attempt") + 1)))


def complete(jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """Jobs with the status and duration of finished (job_id, ok, ended_at)."""
    out = jobs.join(finished, "job_id", "left")
    seconds = (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6
    return out.withColumn("status", F.when(F.col("ok"), "Completed").when(~F.col("ok"), "Failed").otherwise(F.col("status"))).withColumn("duration_s", F.when(F.col("ok").isNotNull(), seconds).otherwise(F.col("duration_s"))).drop("ok", "ended_at")


def stale(jobs: DataFrame, now, timeout_s: float) -> DataFrame:
    """Processing jobs older than twice the timeout."""
    return jobs.filter((F.col("status") == "Processing") & (F.col("created_at") < F.timestamp_seconds(F.unix_timestamp(F.lit(now).cast("timestamp")) - 2 * timeout_s)))


def keep_completed(jobs: DataFrame, most: int) -> DataFrame:
    """Jobs without the oldest completed ones beyond so many."""
    done = jobs.filter("status = 'Completed'").orderBy(F.desc("created_at"), F.desc("job_id")).limit(most)
    return jobs.filter("status <> 'Completed'").unionByName(done)


def distinct_paths(stream: DataFrame, time: str = "last_modified", within: str = "1 day") -> DataFrame:
    """A stream without paths seen before within some time."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(["file_path"])


def running_counts(events: DataFrame, time: str, kind: str, window: str, late: str) -> DataFrame:
    """Events by window and kind, with late ones dropped: for streams of events."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n"))


def worker_load(jobs: DataFrame) -> DataFrame:
    """Per worker: jobs, seconds, and the share of all seconds."""
    per = jobs.groupBy("worker_id").agg(F.count("*").alias("jobs"), F.sum("duration_s").alias("seconds"))
    return per.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy()))
