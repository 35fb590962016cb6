"""Rewards composed from accuracy, format and tool terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import constants as K
from trailmark.functions import geo as G


def geo_score(df: DataFrame, answer: str, truth: str) -> DataFrame:
    """Accuracy, format score, distance (3 decimals) and threshold flags of an answer text.

    Without a readable truth the texts must be equal; without a readable answer all is zero.
    """
    staged = df.withColumns({"__p": G.parse_coords(F.col(answer)), "__g": G.parse_coords(F.col(truth))})
    km = G.haversine_km(F.col("__p.lat"), F.col("__p.lon"), F.col("__g.lat"), F.col("__g.lon"))
    same = (F.trim(answer) == F.trim(truth)).cast("double")
    staged = staged.withColumn("__km", km)
    acc = F.when(F.col("__g").isNull(), same).otherwise(F.coalesce(G.distance_score(F.col("__km")), F.lit(0.0)))
    flags = {f"acc_{t}km": G.threshold_flag(F.col("__km"), t) for t in K.KM_THRESHOLDS}
    return staged.withColumns(
        {"acc": acc, "format": G.format_score(F.col(answer)), "km": F.round("__km", 3), **flags}
    ).drop("__p", "__g", "__km")


def blended_score(acc: Column, fmt: Column, weight: float = K.FORMAT_WEIGHT) -> Column:
    return (1.0 - weight) * acc + weight * fmt


def clip_tools(total: Column) -> Column:
    low, high = K.TOOL_SUM_BOUNDS
    return F.greatest(F.lit(low), F.least(F.lit(high), total))


def composite_reward(samples: DataFrame, calls: DataFrame, key: str, compat: bool = False) -> DataFrame:
    """Weighted accuracy, format and clipped tool rewards of each sample.

    ``compat`` gives what is observed when the scorer returns no separate format term: the format
    counts as zero.
    """
    w = K.REWARD_WEIGHTS
    sums = calls.groupBy(key).agg(F.sum("reward").alias("__tool"))
    joined = samples.join(sums, key, "left")
    tool = F.coalesce(clip_tools(F.col("__tool")), F.lit(0.0))
    fmt = F.lit(0.0) if compat else F.col("format")
    return joined.withColumn("tool", tool).withColumn(
        "final_reward", w["acc"] * F.col("acc") + w["fmt"] * fmt + w["tool"] * F.col("tool")
    ).drop("__tool")


def place_rewards(tok: DataFrame, samples: DataFrame, turns: DataFrame, compat: bool = False, attended: str | None = None) -> DataFrame:
    """Token rewards: the outcome on the last attended token, each turn's clipped tool sum on its end.

    ``attended`` names the column that is 1 for attended tokens; without it every row of ``tok`` is. Tool
    tokens that the loss mask leaves out are attended, so they count towards the end of the answer.

    ``samples``: sample_id, acc, format, final_reward. ``turns``: sample_id, t (end position),
    tool_sum. A sample without turns carries its whole reward on the last attended token. ``compat``
    reads accuracy and format as zero where turns are placed, as observed.
    """
    w = K.REWARD_WEIGHTS
    clipped = turns.groupBy("sample_id", "t").agg(F.sum(clip_tools(F.col("tool_sum"))).alias("__turn"))
    valid = tok.where(F.col(attended) == 1) if attended else tok
    last = valid.groupBy("sample_id").agg(F.max("t").alias("t"))
    with_turns = turns.select("sample_id").distinct().withColumn("__has", F.lit(True))
    outcome = F.lit(0.0) if compat else w["acc"] * F.col("acc") + w["fmt"] * F.col("format")
    ends = (
        last.where("t > 0").join(samples, "sample_id").join(with_turns, "sample_id", "left")
        .select("sample_id", F.col("t"), F.when(F.col("__has"), outcome).otherwise(F.col("final_reward")).alias("__end"))
    )
    joined = tok.join(ends, ["sample_id", "t"], "left").join(clipped, ["sample_id", "t"], "left")
    return joined.withColumn(
        "placed_reward", F.coalesce("__end", F.lit(0.0)) + F.coalesce(F.col("__turn") * w["tool"], F.lit(0.0))
    ).drop("__end", "__turn")


def overlong_penalty(length: Column, max_length: int, buffer: int, factor: float) -> Column:
    """Zero up to the expected length, then linear down."""
    return F.least(-(length - (max_length - buffer)) / buffer * factor, F.lit(0.0))
