"""Streams of rollout samples: ingest, retention, staleness, windows, admission, caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailmark.operators.evaluation import combine_steps
from trailmark.operators.ordering import counted_ladder, ladder_percentiles
from trailmark.session import scratch_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_samples(spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Continuous ingest of parquet files."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends all input available now and stops; a restart goes on where it ended."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()


def each_batch(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None, after: Callable[[int], None] | None = None) -> None:
    """Writes every micro-batch to its own folder, so that a repeated batch replaces itself; then ``after`` has its number."""
    def write(batch: DataFrame, number: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if after:
            after(number)

    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """The last complete result written by :func:`each_batch` in complete mode."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class KeepLatest(StatefulProcessor):
    """Newest ``limit`` ids per key in a list state, and how many were dropped."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "id bigint")
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = [r[0] for r in self.kept.get()]
        seen = self.seen.get()[0] if self.seen.exists() else 0
        for batch in rows:
            seen += len(batch)
            # Only the newest rows are held, however long the input of this key is.
            kept = sorted([*kept, *batch["id"].tolist()])[-self.limit :]
        self.kept.put([(int(i),) for i in kept])
        self.seen.update((int(seen),))
        yield pd.DataFrame(
            {"key": [key[0]], "n_kept": [len(kept)], "n_dropped": [seen - len(kept)], "oldest": [kept[0]], "newest": [kept[-1]]}
        )

    def close(self) -> None:
        pass


def stream_keep_latest(stream: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """Retention of the newest rows per key; each update gives the state of a key."""
    keyed = stream.select(F.col(key).alias("key"), F.col(order).cast("bigint").alias("id"))
    kind = keyed.schema["key"].dataType.simpleString()
    return keyed.groupBy("key").transformWithStateInPandas(
        KeepLatest(limit), f"key {kind}, n_kept int, n_dropped bigint, oldest bigint, newest bigint", "Update", "none"
    )


class TokenBucket(StatefulProcessor):
    """Token bucket in event time. A request that finds too few tokens waits and leaves a debt."""

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens double, at double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        tokens, at = self.bucket.get() if self.bucket.exists() else (self.burst, None)
        # One micro-batch of one key, in event-time order: three numbers per request, bounded by the
        # number of files per trigger.
        batch = pd.concat(list(rows)).sort_values(["at", "id"])
        waits = []
        for now, cost in zip(batch["at"], batch["cost"]):
            if at is not None:
                tokens = min(self.burst, tokens + max(now - at, 0.0) * self.rate)
            at = now if at is None else max(at, now)
            waits.append(max(cost - tokens, 0.0) / self.rate)
            tokens -= cost
        self.bucket.update((float(tokens), float(at)))
        yield pd.DataFrame({"key": key[0], "id": batch["id"], "wait": waits})

    def close(self) -> None:
        pass


def stream_rate_limit(stream: DataFrame, key: str, row_id: str, ts: str, cost: str, rate: float, burst: float) -> DataFrame:
    """Seconds each request waits for admission under a per-key rate and burst."""
    keyed = stream.select(
        F.col(key).alias("key"), F.col(row_id).cast("bigint").alias("id"), F.unix_micros(ts).cast("double").alias("at"), F.col(cost).cast("double").alias("cost")
    ).withColumn("at", F.col("at") / 1e6)
    kind = keyed.schema["key"].dataType.simpleString()
    return keyed.groupBy("key").transformWithStateInPandas(
        TokenBucket(rate, burst), f"key {kind}, id bigint, wait double", "Append", "none"
    )


def stream_staleness(stream: DataFrame, versions: DataFrame, key: str, threshold: int, version: str = "param_version") -> DataFrame:
    """Stream joined with the current version of its key: stale and admitted flags."""
    behind = F.col("current_version") - F.col(version)
    return stream.join(versions.select(key, "current_version"), key).withColumns(
        {"stale": behind >= 1, "admitted": behind <= threshold}
    )


def staleness_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy().agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("stale"), 1)).alias("n_stale"), F.count(F.when(~F.col("admitted"), 1)).alias("n_dropped")
    )


def stream_status(stream: DataFrame, ts: str, length: str, late: str = "1 hour") -> DataFrame:
    """Processing times and partial samples per tumbling window; for percentiles see :func:`stream_value_counts`."""
    span = F.abs(F.col("param_version_end") - F.col("param_version_start"))
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, length))
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg("processing_time").alias("time_avg"), F.max("processing_time").alias("time_max"),
            F.min("processing_time").alias("time_min"), F.count(F.when(span != 0, 1)).alias("n_partial"), F.max(span).alias("max_partial_span"),
        )
        .select(F.col("window.start").alias("start"), "*")
        .drop("window")
    )


def stream_value_counts(stream: DataFrame, ts: str, length: str, late: str = "1 hour") -> DataFrame:
    """Value counts of processing times per tumbling window, with the partial samples among them.

    The state has a row for each window and processing time, so it merges exactly, and a window that holds most of the
    samples spreads over its values. :func:`status_of` turns a result into one row per window.
    """
    span = F.abs(F.col("param_version_end") - F.col("param_version_start"))
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, length), F.col("processing_time").alias("value")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(span != 0, 1)).alias("partial"), F.max(span).alias("span")
    )
    return counted.select(F.col("window.start").alias("start"), "value", "rows", "partial", "span")


def status_of(counts: DataFrame) -> DataFrame:
    """Processing times, their exact percentiles and partial samples of each window, from the counts of a batch."""
    value, rows = F.col("value"), F.col("rows")
    base = counts.groupBy("start").agg(
        F.sum(rows).alias("n"), (F.sum(value * rows) / F.sum(F.when(value.isNotNull(), rows))).alias("time_avg"), F.max(value).alias("time_max"),
        F.min(value).alias("time_min"), F.sum("partial").alias("n_partial"), F.max("span").alias("max_partial_span"),
    )
    points = ladder_percentiles(counted_ladder(counts.where("value is not null").select("start", "value", rows.alias("c")), ["start"]), ["start"], [0.5, 0.95, 0.99])
    times = {"p50": "time_p50", "p95": "time_p95", "p99": "time_p99"}
    return base.join(points.withColumnsRenamed(times), "start", "left")


def stream_step_metrics(stream: DataFrame, ts: str, length: str, late: str = "1 hour") -> DataFrame:
    """Metric rows (``step, metric, value``) combined per tumbling window by the routing rule."""
    windowed = combine_steps(stream.withWatermark(ts, late), [F.window(ts, length).alias("window")])
    return windowed.select(F.col("window.start").alias("start"), "metric", "value")


def stream_dedupe(stream: DataFrame, key: str, ts: str, late: str | None = None) -> DataFrame:
    """Each id once, ever: the checkpoint remembers all ids across restarts.

    With ``late`` an id is forgotten once the event time has moved on by as much, which bounds the state.
    """
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if late else stream.dropDuplicates([key])


def stream_append(stream: DataFrame, generate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Growing dataset: every micro-batch and what is generated from it."""
    each_batch(stream, path, checkpoint, transform=lambda batch: batch.unionByName(generate(batch), allowMissingColumns=True))


def stream_upsert(stream: DataFrame, path: str, checkpoint: str, compact: Callable[[str], None] | None = None, every: int = 100) -> None:
    """Cache updates appended to a log, one folder per batch; readers take the newest row per key.

    Appending keeps the cost of a batch in the size of the batch, not of the cache. ``compact`` (of the path, see
    ``writers.compact_cache_log``) runs after every so many batches and bounds what a reader has to read.
    """
    def folded(number: int) -> None:
        if compact and (number + 1) % every == 0:
            compact(path)

    each_batch(stream, path, checkpoint, after=folded)


def fresh(spark: SparkSession, name: str) -> tuple[str, str]:
    """An output folder and a checkpoint folder."""
    return scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-checkpoint")
