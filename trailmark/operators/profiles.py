"""Exact percentiles, numeric descriptions and length profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.ordering import ladder_percentiles, spread_ladder


def percentile_row(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """One row with the exact percentiles (linear interpolation) of a numeric column.

    Values are counted first, so a value that holds a third of the rows is one row from then on,
    and the cumulative counts are taken over value buckets instead of in one task.
    """
    ladder = spread_ladder(df.select(F.lit(0).alias("__all"), F.col(value).cast("double").alias("value")), ["__all"])
    row = ladder_percentiles(ladder, ["__all"], probs).drop("__all")
    # One row of nulls if there is no value.
    return row.agg(*[F.first(c).alias(c) for c in row.columns])


def length_profile(df: DataFrame, length: str, max_length: int) -> DataFrame:
    """Minimum, maximum, mean, percentiles and over-limit share of lengths; a null length failed."""
    size = F.col(length)
    base = df.agg(
        F.count(size).alias("n"),
        F.count(F.when(size.isNull(), 1)).alias("n_failed"),
        F.min(size).alias("min_length"),
        F.max(size).alias("max_length"),
        F.avg(size).alias("mean_length"),
        F.count(F.when(size > max_length, 1)).alias("n_over"),
    )
    points = percentile_row(df, length, [0.5, 0.75, 0.9, 0.95, 0.99])
    row = points.select(F.struct("*").alias("p")).scalar()
    return (
        base.withColumn("over_share", F.try_divide(F.col("n_over").cast("double"), F.col("n")))
        .withColumn("__p", row)
        .select("*", "__p.*")
        .drop("__p")
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles; one row per column.

    All columns are melted and read together, once for the moments and once for one ladder of all their values,
    whatever their number.
    """
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.inline(lines))
    moments = long.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    quartiles = ladder_percentiles(spread_ladder(long, ["column"]), ["column"], [0.25, 0.5, 0.75])
    # A row for each column, also of an empty table.
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(F.broadcast(moments), "column", "left").join(F.broadcast(quartiles), "column", "left").na.fill(0, ["n"])
