"""Streams over several micro-batches and restarts against brute force."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailmark import registry as L
from trailmark.streaming import streams as K

SCHEMA = "id bigint, key string, ts timestamp, cost double"


@pytest.fixture()
def folder(spark, tmp_path):
    """Three files, one micro-batch each."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", start + dt.timedelta(seconds=(i * 37) % 11 + i * 4), float(1 + i % 9)) for i in range(90)]
    for part in range(3):
        frame = spark.createDataFrame(rows[part * 30 : part * 30 + 30], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), rows


def stream(spark, folder):
    return K.stream_samples(spark, folder[0], SCHEMA, files_per_trigger=1)


def test_retention_over_batches(spark, folder):
    K.with_state_store(spark)
    out, checkpoint = K.fresh(spark, "t")
    K.each_batch(K.stream_keep_latest(stream(spark, folder), "key", "id", 4), out, checkpoint, "update")
    got = spark.read.parquet(out).toPandas().sort_values("batch").groupby("key").last()
    for key, rows in pd.DataFrame(folder[1], columns=["id", "key", "ts", "cost"]).groupby("key"):
        ids = sorted(rows.id)
        assert got.loc[key, "n_kept"] == min(4, len(ids))
        assert got.loc[key, "n_dropped"] == max(0, len(ids) - 4)
        assert got.loc[key, "oldest"] == ids[-4:][0] and got.loc[key, "newest"] == ids[-1]


def test_rate_limit_within_one_batch(spark, folder):
    K.with_state_store(spark)
    out, checkpoint = K.fresh(spark, "t")
    whole = K.stream_samples(spark, folder[0], SCHEMA)
    K.append_available(K.stream_rate_limit(whole, "key", "id", "ts", "cost", rate=0.5, burst=6.0), out, checkpoint)
    got = {r.id: r.wait for r in spark.read.parquet(out).collect()}
    rows = pd.DataFrame(folder[1], columns=["id", "key", "ts", "cost"])
    assert len(got) == len(rows)
    for _, of_key in rows.groupby("key"):
        tokens, at = 6.0, None
        for r in of_key.sort_values(["ts", "id"]).itertuples():
            now = r.ts.timestamp()
            if at is not None:
                tokens = min(6.0, tokens + (now - at) * 0.5)
            at = now
            assert got[r.id] == pytest.approx(max(0.0, r.cost - tokens) / 0.5)
            tokens -= r.cost


def test_dedupe_survives_a_restart(spark, folder):
    out, checkpoint = K.fresh(spark, "t")
    for _ in range(2):
        K.append_available(K.stream_dedupe(stream(spark, folder), "id", "ts"), out, checkpoint)
        spark.createDataFrame(folder[1][80:], SCHEMA).coalesce(1).write.mode("append").parquet(folder[0])
    ids = [r.id for r in spark.read.parquet(out).collect()]
    assert sorted(ids) == list(range(90))


def test_status_equals_batch(spark, folder):
    staged = stream(spark, folder).select(
        "ts", F.col("cost").alias("processing_time"), F.col("id").alias("param_version_start"), (F.col("id") + F.col("id") % 2).alias("param_version_end")
    )
    out, checkpoint = K.fresh(spark, "t")
    K.each_batch(K.stream_status(staged, "ts", "1 minute"), out, checkpoint, "complete")
    got = K.latest_batch(spark, out).toPandas().set_index("start").sort_index()
    rows = pd.DataFrame(folder[1], columns=["id", "key", "ts", "cost"])
    want = rows.groupby(rows.ts.dt.floor("1min")).agg(n=("id", "count"), avg=("cost", "mean"))
    assert got.n.tolist() == want.n.tolist()
    assert got.time_avg.tolist() == pytest.approx(want.avg.tolist())


def test_status_has_exact_percentiles(spark, folder):
    staged = stream(spark, folder).select(
        "ts", F.when(F.col("id") % 3 > 0, F.col("cost")).alias("processing_time"), F.lit(1).alias("param_version_start"), (F.col("id") % 2).alias("param_version_end")
    )
    out, checkpoint = K.fresh(spark, "t")
    K.each_batch(K.stream_value_counts(staged, "ts", "1 minute"), out, checkpoint, "complete", K.status_of)
    got = K.latest_batch(spark, out).toPandas().set_index("start").sort_index()
    rows = pd.DataFrame(folder[1], columns=["id", "key", "ts", "cost"])
    rows.loc[rows.id % 3 == 0, "cost"] = None
    by = rows.groupby(rows.ts.dt.floor("1min")).cost
    assert got.n.tolist() == by.size().tolist() and got.time_avg.tolist() == pytest.approx(by.mean().tolist(), nan_ok=True)
    for name, p in (("time_p50", 0.5), ("time_p95", 0.95), ("time_p99", 0.99)):
        assert got[name].tolist() == pytest.approx(by.quantile(p).tolist(), nan_ok=True)


def test_cache_log_takes_the_newest(spark, folder):
    from trailmark.sources.writers import read_cache_log

    out, checkpoint = K.fresh(spark, "t")
    K.stream_upsert(stream(spark, folder).select("key", "id", "cost"), out, checkpoint)
    got = {r.key: r.id for r in read_cache_log(spark, out, "key", "id").collect()}
    assert got == pd.DataFrame(folder[1], columns=["id", "key", "ts", "cost"]).groupby("key").id.max().to_dict()


def test_compaction_and_a_crash_in_it(spark, folder):
    from trailmark.sources import writers as Wr

    def current(path):
        return {r.key: (r.id, r.v) for r in Wr.read_cache_log(spark, path, "key", "id").collect()}

    def append(path, number, rows):
        spark.createDataFrame(rows, "key string, id long, v string").write.mode("overwrite").parquet(f"{path}/batch={number}")

    path, _ = K.fresh(spark, "log")
    append(path, 0, [("a", 1, "a1"), ("b", 1, "b1")])
    append(path, 1, [("a", 2, "a2"), ("c", 1, "c1")])
    Wr.compact_cache_log(spark, path, "key", "id")
    assert current(path) == {"a": (2, "a2"), "b": (1, "b1"), "c": (1, "c1")}
    assert not [n for n in Wr._children(spark, path) if n.startswith("batch=")]
    append(path, 2, [("b", 1, "same order, later batch"), ("d", 5, "d5")])
    want = {"a": (2, "a2"), "b": (1, "same order, later batch"), "c": (1, "c1"), "d": (5, "d5")}
    # The snapshot is written, but the writer ends before the manifest is.
    assert Wr.write_snapshot(spark, path, "key", "id") is not None
    assert current(path) == want and Wr.cache_manifest(spark, path)[2] == 1
    # A batch that is in force already comes again, and a manifest without its file.
    spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/version=9").getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/version=9"))
    append(path, 1, [("a", 2, "again"), ("c", 1, "again")])
    assert current(path) == want
    for _ in range(2):
        Wr.compact_cache_log(spark, path, "key", "id")
        assert current(path) == want
    assert len(spark.read.parquet(Wr.cache_manifest(spark, path)[1]).inputFiles()) > 0 and Wr.cache_manifest(spark, path)[2] == 2


def test_upsert_with_compaction(spark, folder):
    from trailmark.sources import writers as Wr

    out, checkpoint = K.fresh(spark, "t")
    K.stream_upsert(stream(spark, folder).select("key", "id", "cost"), out, checkpoint, lambda path: Wr.compact_cache_log(spark, path, "key", "id"), every=2)
    got = {r.key: r.id for r in Wr.read_cache_log(spark, out, "key", "id").collect()}
    assert got == pd.DataFrame(folder[1], columns=["id", "key", "ts", "cost"]).groupby("key").id.max().to_dict()
    assert Wr.cache_manifest(spark, out)[0] >= 1


def test_registries(spark):
    df = spark.createDataFrame([("s", "abc", "abc"), ("s", "x", "y")], "s string, a string, t string")
    L.register_reward("same", lambda s, a, t, extra, bonus: {"score": float(a == t), "extra": bonus}, fields=["score", "extra"], bonus=2.0)
    got = [tuple(r.reward) for r in L.apply_reward(df, "same", "s", "a", "t").collect()]
    assert got == [(1.0, 2.0), (0.0, 2.0)]
    with pytest.raises(ValueError, match="already registered"):
        L.register_advantage("grpo", lambda d: d)
    with pytest.raises(ValueError, match="unknown advantage"):
        L.compute_advantage(df, "nothing")
