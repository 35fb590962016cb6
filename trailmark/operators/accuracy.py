"""Distance accuracy of prediction runs and comparison of two runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions import constants as K


def _share(hits: Column, total: Column, digits: int) -> Column:
    """Rounded ratio; 0 for an empty denominator."""
    return F.coalesce(F.round(F.try_divide(hits.cast("double"), total.cast("double")), digits), F.lit(0.0))


def accuracy_summary(
    df: DataFrame,
    by: Sequence[str] = (),
    km: str = "km",
    denominator: str = "all",
    call_columns: Sequence[str] = ("n_tool_calls",),
) -> DataFrame:
    """Accuracy at the standard thresholds, parse rate and mean call counts.

    ``denominator`` is ``all`` rows (an unparsed row counts as wrong) or ``parsed`` rows only.
    """
    if denominator not in ("all", "parsed"):
        raise ValueError(f"denominator must be all or parsed, not {denominator!r}")
    distance = F.col(km)
    total, parsed = F.count(F.lit(1)), F.count(distance)
    base = total if denominator == "all" else parsed
    return df.groupBy(*by).agg(
        total.alias("n_total"),
        parsed.alias("n_parsed"),
        (total - parsed).alias("n_no_pred"),
        _share(parsed, total, 4).alias("parse_rate"),
        *[
            _share(F.count(F.when(distance <= t, 1)), base, 4).alias(f"acc_{t}km")
            for t in K.KM_THRESHOLDS
        ],
        *[
            F.round(F.sum(F.coalesce(F.col(c), F.lit(0))) / F.greatest(total, F.lit(1)), 3).alias(f"avg_{c}")
            for c in call_columns
        ],
    )


def dedupe_last(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last row per key; ``order`` (descending columns) must be total.

    The rank is limited to one, so Spark drops the other rows of a hot key before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    newest = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").drop("__rn")


def compare_runs(a: DataFrame, b: DataFrame, key: str = "id", km: str = "km") -> DataFrame:
    """Inner join of two runs on id with the distance change, pass flags and a change summary."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.withColumnsRenamed({c: f"{c}_{tag}" for c in df.columns if c != key})

    joined = side(a, "a").join(side(b, "b"), key)
    km_a, km_b = F.col(f"{km}_a"), F.col(f"{km}_b")
    flags, changes = {}, []
    for t in K.COMPARE_THRESHOLDS:
        pass_a, pass_b = F.coalesce(km_a <= t, F.lit(False)), F.coalesce(km_b <= t, F.lit(False))
        flags[f"pass_a_{t}"], flags[f"pass_b_{t}"] = pass_a, pass_b
        changes.append(F.when(~pass_a & pass_b, f"↑@{t}km").when(pass_a & ~pass_b, f"↓@{t}km"))
    tags = F.filter(F.array(*changes), lambda tag: tag.isNotNull())
    return joined.withColumns(
        {
            f"{km}_delta": km_b - km_a,
            **flags,
            "change_summary": F.when(F.size(tags) > 0, F.array_join(tags, " | ")).otherwise("—"),
        }
    )


def common_accuracy(compared: DataFrame, km: str = "km") -> DataFrame:
    """Accuracy of both runs over their common rows, one row per threshold."""
    total = F.count(F.lit(1))
    wide = compared.agg(
        total.alias("n_common"),
        *[
            _share(F.count(F.when(F.col(f"{km}_{side}") <= t, 1)), total, 6).alias(f"{side}_{t}")
            for t in K.COMPARE_THRESHOLDS
            for side in "ab"
        ],
    )
    lines = F.array(
        *[
            F.struct(F.lit(t).alias("threshold"), F.col(f"a_{t}").alias("acc_a"), F.col(f"b_{t}").alias("acc_b"))
            for t in K.COMPARE_THRESHOLDS
        ]
    )
    return wide.select("n_common", F.inline(lines)).withColumn("delta", F.round(F.col("acc_b") - F.col("acc_a"), 6))


def change_counts(compared: DataFrame, km: str = "km") -> DataFrame:
    """Number of common rows per change category."""
    counts = {}
    for t in K.COMPARE_THRESHOLDS:
        a, b = F.col(f"pass_a_{t}"), F.col(f"pass_b_{t}")
        counts[f"improved_{t}"], counts[f"regressed_{t}"] = ~a & b, a & ~b
    counts["no_prediction_a"], counts["no_prediction_b"] = F.col(f"{km}_a").isNull(), F.col(f"{km}_b").isNull()
    wide = compared.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in counts.items()])
    lines = F.array(*[F.struct(F.lit(n).alias("category"), F.col(n).alias("n")) for n in counts])
    return wide.select(F.inline(lines))


def scaling_curve(spark, summaries: DataFrame, first: int = 200, last: int = 5600, step: int = 200) -> DataFrame:
    """Summaries at the expected checkpoints in order; missing checkpoints are skipped.

    A summary without one of the accuracy columns is an error.
    """
    wanted = [f"acc_{t}km" for t in K.KM_THRESHOLDS]
    missing = [c for c in wanted if c not in summaries.columns]
    if missing:
        raise KeyError(f"summaries lack {missing}")
    expected = spark.range(first, last + 1, step).select(F.col("id").cast("int").alias("step"))
    present = summaries.withColumn("__present", F.lit(True))
    return (
        expected.join(present, "step", "left")
        .where("__present")
        .select("step", F.floor(F.col("step") / 20).cast("int").alias("train_images"), *wanted)
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def attach(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left lookup in which an absent value takes its default."""
    joined = left.join(right.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
