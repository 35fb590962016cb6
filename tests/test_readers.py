"""Readers over hand-made files."""

import pytest
from pyspark.sql import functions as F

from trailmark.sources import readers as R
from trailmark.sources.writers import write_samples


@pytest.fixture
def lines(tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text('{"id": "a", "km": 1.5}\n\n{"id": "b", "km": \n{"id": "c"}\n')
    return str(path)


def test_tolerant_scan_skips_malformed_lines(spark, lines):
    rows = R.read_trajectories(spark, lines, "drop", "id string, km double").collect()
    assert sorted((r.id, r.km) for r in rows) == [("a", 1.5), ("c", None)]


def test_strict_scan_stops_at_a_malformed_line(spark, lines):
    with pytest.raises(Exception, match="(?i)malformed"):
        R.read_trajectories(spark, lines, "fail", "id string, km double").collect()


def test_samples_of_one_task_are_written_by_several(spark, tmp_path):
    text = F.sha2(F.col("id").cast("string"), 256)
    rows = spark.range(0, 100_000, 1, 1).select(
        F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"), F.array(F.struct(text.alias("image"))).alias("images"),
        F.lit("l0").alias("version"), F.lit("train").alias("split"),
    )
    path = str(tmp_path / "samples")
    write_samples(rows, path)
    assert len(list((tmp_path / "samples" / "version=l0" / "split=train").glob("*.parquet"))) > 1
    assert spark.read.parquet(path).select("messages", "images", "version", "split").exceptAll(rows).isEmpty()
    assert spark.read.parquet(path).count() == 100_000
