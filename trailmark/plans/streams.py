"""Streaming queries, run over all input available now."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.plans.fixtures import table
from trailmark.plans.registry import query
from trailmark.sources.writers import compact_cache_log, read_cache_log
from trailmark.streaming import streams as K

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark, sf):
    """The events as a stream of rollout samples."""
    raw = K.stream_samples(spark, sf, EVENTS, "events.parquet")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.col("value").alias("processing_time"),
        F.floor(F.col("event_id") / 512).cast("int").alias("step"), (k % 7).alias("param_version"), k.alias("param_version_start"), (k + k % 5).alias("param_version_end"),
    )


@query("stream_ingest", "select event_id, user_id, value as processing_time from events")
def stream_ingest(spark, sf):
    out, checkpoint = K.fresh(spark, "ingest")
    K.append_available(events(spark, sf), out, checkpoint)
    return spark.read.parquet(out).select("event_id", "user_id", "processing_time")


@query(
    "stream_retention",
    """select user_id as key, cast(count(*) filter (where r<=20) as int) as n_kept, count(*) filter (where r>20) as n_dropped, min(event_id) filter (where r<=20) as oldest, max(event_id) as newest
 from (select *, row_number() over(partition by user_id order by event_id desc) as r from events) group by 1""",
)
def stream_retention(spark, sf):
    K.with_state_store(spark)
    out, checkpoint = K.fresh(spark, "retention")
    K.each_batch(K.stream_keep_latest(events(spark, sf), "user_id", "event_id", 20), out, checkpoint, "update")
    states = spark.read.parquet(out)
    newest = states.groupBy("key").agg(F.max_by(F.struct("n_kept", "n_dropped", "oldest", "newest"), "batch").alias("s"))
    return newest.select("key", "s.*")


VERSIONS = "(select event_type, cast(length(event_type)%5+2 as bigint) as current_version from events group by 1)"


@query(
    "stream_staleness",
    f"""select count(*) as n, count(*) filter (where d>=1) as n_stale, count(*) filter (where d>2) as n_dropped from (
 select v.current_version-cast(json_extract(props,'$.k') as bigint)%7 as d from events e join {VERSIONS} v on v.event_type=e.event_type)""",
)
def stream_staleness(spark, sf):
    versions = table(spark, sf, "events").select("event_type").distinct().withColumn("current_version", (F.length("event_type") % 5 + 2).cast("bigint"))
    out, checkpoint = K.fresh(spark, "staleness")
    K.append_available(K.stream_staleness(events(spark, sf), versions, "event_type", 2), out, checkpoint)
    return K.staleness_counts(spark.read.parquet(out))


@query(
    "stream_status",
    """select time_bucket(interval '1 day', ts) as start, count(*) as n, round(avg(value)+3e-8,6) as time_avg, max(value) as time_max, min(value) as time_min, count(*) filter (where k%5<>0) as n_partial, max(k%5) as max_partial_span,
 round(quantile_cont(value,0.5),6) as time_p50, round(quantile_cont(value,0.95),6) as time_p95, round(quantile_cont(value,0.99),6) as time_p99
 from (select *, cast(json_extract(props,'$.k') as bigint) as k from events) group by 1""",
)
def stream_status(spark, sf):
    out, checkpoint = K.fresh(spark, "status")
    K.each_batch(K.stream_value_counts(events(spark, sf), "ts", "1 day"), out, checkpoint, "complete", K.status_of)
    rows = K.latest_batch(spark, out)
    # A mean of two-decimal values may end in a five; a little more on both sides keeps it off the tie.
    off = F.col("time_avg") + 3e-8
    return rows.withColumn("time_avg", off).withColumns({c: F.round(c, 6) for c in ("time_avg", "time_p50", "time_p95", "time_p99")})


@query(
    "stream_step_metrics",
    """select start, metric, round(value,6) as value from (select time_bucket(interval '1 day', ts) as start, 'reward/max' as metric, max(value) as value from events group by 1
 union all select time_bucket(interval '1 day', ts), 'timing_s/gen', sum(value) from events group by 1
 union all select time_bucket(interval '1 day', ts), 'training/global_step', arg_max(floor(event_id/512)*1.0, event_id) from events group by 1)""",
)
def stream_step_metrics(spark, sf):
    stream = events(spark, sf)
    lines = F.array(
        F.struct(F.lit("reward/max").alias("metric"), F.col("processing_time").alias("value")),
        F.struct(F.lit("timing_s/gen").alias("metric"), F.col("processing_time").alias("value")),
        F.struct(F.lit("training/global_step").alias("metric"), F.col("step").cast("double").alias("value")),
    )
    metrics = stream.select("ts", F.col("event_id").alias("step"), F.inline(lines))
    out, checkpoint = K.fresh(spark, "step-metrics")
    K.each_batch(K.stream_step_metrics(metrics, "ts", "1 day"), out, checkpoint, "complete")
    return K.latest_batch(spark, out).withColumn("value", F.round("value", 6))


@query("stream_dedupe", "select distinct event_id from events")
def stream_dedupe(spark, sf):
    # Every event is sent twice.
    doubled = events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out, checkpoint = K.fresh(spark, "dedupe")
    K.append_available(K.stream_dedupe(doubled, "event_id", "ts"), out, checkpoint)
    return spark.read.parquet(out).select("event_id")


@query("stream_rate_limit")
def stream_rate_limit(spark, sf):
    K.with_state_store(spark)
    stream = events(spark, sf).withColumn("cost", 1 + F.col("event_id") % 40)
    out, checkpoint = K.fresh(spark, "rate")
    K.append_available(K.stream_rate_limit(stream, "user_id", "event_id", "ts", "cost", rate=0.001, burst=30.0), out, checkpoint)
    return spark.read.parquet(out)


@query("stream_growth", "select event_id, 'seen' as origin from events union all select event_id, 'made' from events where value>50")
def stream_growth(spark, sf):
    out, checkpoint = K.fresh(spark, "growth")
    seen = events(spark, sf).withColumn("origin", F.lit("seen"))
    K.stream_append(seen, lambda batch: batch.where("processing_time > 50").withColumn("origin", F.lit("made")), out, checkpoint)
    return spark.read.parquet(out).select("event_id", "origin")


@query("stream_cache_upsert", "select user_id as key, arg_max(value, event_id) as value, max(event_id) as created from events group by 1")
def stream_cache_upsert(spark, sf):
    out, checkpoint = K.fresh(spark, "cache")
    updates = events(spark, sf).select(F.col("user_id").alias("key"), F.col("processing_time").alias("value"), F.col("event_id").alias("created"))
    K.stream_upsert(updates, out, checkpoint, lambda path: compact_cache_log(spark, path, "key", "created"), every=1)
    return read_cache_log(spark, out, "key", "created").select("key", "value", "created")


