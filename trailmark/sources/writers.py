"""Sinks: sample tables, rollout dumps, metric logs and latest-wins caches."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators.accuracy import dedupe_last
from trailmark.sources.schemas import SFT_SAMPLE, schema


def write_samples(df: DataFrame, path: str, by: Sequence[str] = ("version", "split")) -> None:
    """Nested samples in one folder per version and split, with the fixed sample schema.

    The writer sorts a task's rows by folder, so they are dealt out first: a small file may be a single task and give many rows.
    """
    fixed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(SFT_SAMPLE)]
    dealt = [F.col(f.name) for f in schema(SFT_SAMPLE)]
    df.select(*fixed, *by).hint("rebalance", *dealt).write.mode("overwrite").partitionBy(*by).parquet(path)


def complete_columns(df: DataFrame, required: Sequence[str], extras: Sequence[str]) -> list[str]:
    """Extra columns that have a value in every row; one aggregation, one row back."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in extras]).first()
    return [*required, *[c for c in extras if counts[c] == counts["__n"]]]


def write_rollout_dump(df: DataFrame, path: str, extras: Sequence[str] = ()) -> None:
    """Rollouts as JSON lines in one folder per step; incomplete extra columns are left out."""
    kept = complete_columns(df, ["input", "output", "gts", "score", "step"], extras)
    df.select(*kept).write.mode("overwrite").partitionBy("step").json(path)


def metric_log(df: DataFrame, step: str = "step", sep: str = "/") -> DataFrame:
    """Long metric rows from nested numeric columns: struct fields are named ``outer/inner``."""
    def leaves(prefix: str, column: str, kind) -> list[tuple[str, str]]:
        if hasattr(kind, "fields"):
            return [leaf for f in kind.fields for leaf in leaves(f"{prefix}{sep}{f.name}", f"{column}.`{f.name}`", f.dataType)]
        return [(prefix, column)]

    every = [leaf for f in df.schema.fields if f.name != step for leaf in leaves(f.name, f"`{f.name}`", f.dataType)]
    lines = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in every])
    return df.select(step, F.inline(lines)).where("value is not null")


def write_metric_log(df: DataFrame, path: str, step: str = "step") -> None:
    metric_log(df, step).write.mode("append").json(path)


def upsert_latest(cache: DataFrame, updates: DataFrame, key: str, order: str, ties: Sequence[Column] = ()) -> DataFrame:
    """Cache with updates applied: the newest row per key wins."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return dedupe_last(both, key, [F.col(order).desc(), F.col("__new").desc(), *ties]).drop("__new")


# A cache log holds one folder of updates per batch, and beside them, hidden from readers of the updates, snapshots and
# the manifest. The newest version of the manifest names the snapshot in force and the last batch that is in it.
MANIFEST = "snapshot string, upto bigint"


def _children(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cache_manifest(spark: SparkSession, path: str) -> tuple[int, str | None, int]:
    """Version, snapshot and last batch in it; version 0 without a snapshot. A version without its file does not count."""
    versions = sorted((int(n.split("=")[1]) for n in _children(spark, f"{path}/_manifest") if n.startswith("version=")), reverse=True)
    for version in versions:
        folder = f"{path}/_manifest/version={version}"
        if "_SUCCESS" in _children(spark, folder):
            row = spark.read.schema(MANIFEST).parquet(folder).first()
            return version, row.snapshot, row.upto
    return 0, None, -1


def read_cache_log(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """Current rows of a cache kept as a log of updates (one folder per batch) on top of a snapshot.

    Read are the snapshot in force and the batches after it. Of equal orders the later batch wins.
    """
    _, snapshot, upto = cache_manifest(spark, path)
    after = sorted(n for n in _children(spark, path) if n.startswith("batch=") and int(n.split("=")[1]) > upto)
    parts = [spark.read.parquet(snapshot)] if snapshot else []
    if after or not parts:
        parts.append(spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in after] or [path]))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return dedupe_last(rows, key, [F.col(order).desc(), F.col("batch").desc()])


def write_snapshot(spark: SparkSession, path: str, key: str, order: str) -> tuple[str, int] | None:
    """Writes the current rows aside, in force for nobody yet; None if no batch has come since the last snapshot."""
    batches = [int(n.split("=")[1]) for n in _children(spark, path) if n.startswith("batch=")]
    upto = max(batches, default=-1)
    if upto <= cache_manifest(spark, path)[2]:
        return None
    snapshot = f"{path}/_snapshots/{uuid.uuid4().hex}"
    read_cache_log(spark, path, key, order).write.parquet(snapshot)
    return snapshot, upto


def commit_snapshot(spark: SparkSession, path: str, snapshot: str, upto: int) -> None:
    """Puts a snapshot in force, then removes the batches in it and the snapshot before it."""
    version, old, _ = cache_manifest(spark, path)
    spark.createDataFrame([(snapshot, upto)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest/version={version + 1}")
    for name in _children(spark, path):
        if name.startswith("batch=") and int(name.split("=")[1]) <= upto:
            _remove(spark, f"{path}/{name}")
    if old:
        _remove(spark, old)


def compact_cache_log(spark: SparkSession, path: str, key: str, order: str) -> None:
    """Folds the updates so far into a new snapshot, so that a read costs the cache and the updates since.

    The manifest is written when the snapshot is complete. A failure before leaves the old snapshot and all updates in
    force; one after leaves folders that nobody reads and that the next compaction removes. One writer compacts at a time.
    """
    written = write_snapshot(spark, path, key, order)
    if written:
        commit_snapshot(spark, path, *written)
