"""Group-relative advantages on sequence rows and return-based ones on token rows.

Sequence rows: ``uid`` (prompt), ``sample_id``, ``score``, ``n_tokens``.
Token rows: ``sample_id``, ``t`` (from one), ``uid``, ``mask``, ``reward`` and log-probabilities.
Windows on token rows run within one sequence, which the response length bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.operators.groups import attach_lookup, attach_stats
from trailmark.operators.policy import unbiased_variance

SCORE = "score"


def _stats(df: DataFrame, **aggs: Column) -> DataFrame:
    return attach_stats(df, ["uid"], aggs, "sample_id")


def grpo(df: DataFrame, eps: float = 1e-6, by_std: bool = True, floor: bool = False) -> DataFrame:
    """Score relative to its group: mean 0 and deviation 1 for a lone sample.

    ``floor`` bounds the variance from below by eps before the root, as the vectorised form does.
    """
    out = _stats(df, __c=F.count(F.lit(1)), __m=F.avg(SCORE), __v=F.var_samp(SCORE))
    lone = F.col("__c") <= 1
    mean = F.when(lone, 0.0).otherwise(F.col("__m"))
    variance = F.greatest(F.col("__v"), F.lit(eps)) if floor else F.col("__v")
    deviation = F.when(lone, 1.0).otherwise(F.sqrt(variance))
    centred = F.col(SCORE) - mean
    value = centred / (deviation + eps) if by_std else centred
    return out.withColumn("advantage", value).drop("__c", "__m", "__v")


def grpo_passk(df: DataFrame, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """Only the best of a group is rewarded, by its lead over the second; a lone sample is an error."""
    rank = W.partitionBy("uid").orderBy(F.col(SCORE).desc(), "sample_id")
    # The rank limit leaves two rows per group and task before the shuffle.
    top = df.select("uid", "sample_id", SCORE).withColumn("__r", F.row_number().over(rank)).where("__r <= 2")
    lead = top.groupBy("uid").agg(
        F.max(F.when(F.col("__r") == 1, F.col("sample_id"))).alias("__best"),
        (F.max(F.when(F.col("__r") == 1, F.col(SCORE))) - F.max(F.when(F.col("__r") == 2, F.col(SCORE)))).alias("__lead"),
    )
    spread = df.groupBy("uid").agg(F.count(F.lit(1)).alias("__c"), F.stddev_samp(SCORE).alias("__s"))
    checked = F.when(F.col("__c") >= 2, F.col("__lead")).otherwise(
        F.raise_error(F.concat(F.lit("a group needs two samples: "), F.col("uid").cast("string"))).cast("double")
    )
    best = lead.join(spread, "uid").select(
        F.col("__best").alias("sample_id"),
        (checked / (F.coalesce("__s", F.lit(0.0)) + eps) if by_std else checked).alias("__gain"),
    )
    return df.join(best, "sample_id", "left").withColumn("advantage", F.coalesce("__gain", F.lit(0.0))).drop("__gain")


def rloo(df: DataFrame, singleton: str = "keep") -> DataFrame:
    """Score against the mean of the others; a lone sample keeps its score or takes ``zero``."""
    out = _stats(df, __c=F.count(F.lit(1)), __m=F.avg(SCORE))
    factor = F.col("__c") / F.greatest(F.col("__c") - 1, F.lit(1))
    lone = F.col(SCORE) if singleton == "keep" else F.lit(0.0)
    value = F.when(F.col("__c") > 1, (F.col(SCORE) - F.col("__m")) * factor).otherwise(lone)
    return out.withColumn("advantage", value).drop("__c", "__m")


def opo(df: DataFrame) -> DataFrame:
    """Score against the length-weighted mean of its group."""
    out = _stats(df, __c=F.count(F.lit(1)), __b=F.sum(F.col(SCORE) * F.col("n_tokens")) / F.sum("n_tokens"))
    base = F.when(F.col("__c") > 1, F.col("__b")).otherwise(0.0)
    return out.withColumn("advantage", F.col(SCORE) - base).drop("__c", "__b")


def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """Centred score scaled by rows over non-zero scores."""
    alpha = df.agg(F.count(F.lit(1)) / F.greatest(F.count(F.when(F.col(SCORE) != 0, 1)), F.lit(1))).scalar()
    out = _stats(df, __c=F.count(F.lit(1)), __m=F.avg(SCORE))
    mean = F.when(F.col("__c") > 1, F.col("__m")).otherwise(0.0)
    return out.withColumn("advantage", alpha * (F.col(SCORE) - mean) / f_norm).drop("__c", "__m")


def rfpp_baseline(df: DataFrame) -> DataFrame:
    """Centred by group, then whitened over all valid tokens (each score counts once per token)."""
    out = _stats(df, __c=F.count(F.lit(1)), __m=F.avg(SCORE))
    centred = out.withColumn("__x", F.col(SCORE) - F.when(F.col("__c") > 1, F.col("__m")).otherwise(0.0))
    n, x = F.col("n_tokens").cast("double"), F.col("__x")
    # The scores are centred already, so plain sums lose nothing.
    total, first, second = F.sum(n), F.sum(n * x), F.sum(n * x * x)
    moments = centred.agg(
        F.struct(total.alias("n"), (first / total).alias("mean"), (second - first * first / total).alias("squares"))
    ).scalar()
    return whiten_column(centred.withColumn("__mo", moments), "__x", "__mo", "advantage").drop("__c", "__m", "__x", "__mo")


def whiten_column(df: DataFrame, value: str, moments: str, out: str) -> DataFrame:
    """Whitened value from a struct of masked count, mean and squared deviations."""
    n, mean = F.col(f"{moments}.n"), F.col(f"{moments}.mean")
    variance = unbiased_variance(n, mean, F.col(f"{moments}.squares"))
    return df.withColumn(out, (F.col(value) - mean * n / (n + 1e-8)) / F.sqrt(variance + 1e-8))


def masked_moments(df: DataFrame, value: str, mask: str = "mask") -> Column:
    """Scalar struct of masked count, mean and squared deviations."""
    kept = F.when(F.col(mask) != 0, F.col(value))
    n = F.count(kept).cast("double")
    return df.agg(F.struct(n.alias("n"), F.avg(kept).alias("mean"), (F.var_pop(kept) * n).alias("squares"))).scalar()


def whiten(df: DataFrame, value: str, out: str, mask: str = "mask") -> DataFrame:
    return whiten_column(df.withColumn("__mo", masked_moments(df, value, mask)), value, "__mo", out).drop("__mo")


def _forward() -> W:
    return W.partitionBy("sample_id").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)


def _backward() -> W:
    return W.partitionBy("sample_id").orderBy("t").rowsBetween(W.currentRow, W.unboundedFollowing)


def remax(tok: DataFrame, baseline: str) -> DataFrame:
    """Reward to go minus a per-sequence baseline on valid tokens."""
    out = tok.withColumn("returns", F.sum(F.col("reward") * F.col("mask")).over(_backward()))
    return out.withColumn("advantage", F.col("returns") - F.col(baseline) * F.col("mask"))


def response_mask(tok: DataFrame, eos: list[int], token: str = "token_id") -> DataFrame:
    """1 up to and including the first end token."""
    is_end = F.col(token).isin(eos).cast("int")
    return tok.withColumn("response_mask", (F.sum(is_end).over(_forward()) - is_end == 0).cast("int"))


def _scan(tok: DataFrame, inputs: list[str], output: str, step: Callable[..., np.ndarray]) -> DataFrame:
    """Adds a backward recurrence over the tokens of each sequence.

    A sequence becomes one row of arrays; a batch of them is one padded matrix per input column, and
    ``step`` fills the output matrix, vectorised over the sequences. Only the inputs go through
    Python, and the other columns stay where they are, so there is one shuffle and no join back.
    """
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            sizes = columns[0].map(len).to_numpy()
            width = int(sizes.max()) if len(sizes) else 0
            inside = np.arange(width)[None, :] < sizes[:, None]
            grids = []
            for column in columns:
                grid = np.zeros((len(sizes), width))
                if width:
                    grid[inside] = np.concatenate(column.to_numpy())
                grids.append(grid)
            filled = step(inside, *grids)
            yield pd.Series([filled[i, :n] for i, n in enumerate(sizes)])

    others = [c for c in tok.columns if c not in ("sample_id", "t")]
    packed = tok.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("t", *others))).alias("__p"))
    arrays = [F.col(f"__p.{c}").cast("array<double>") for c in inputs]
    scanned = packed.withColumn("__o", run(*arrays))
    rows = F.zip_with("__p", "__o", lambda p, o: p.withField(output, o))
    return scanned.select("sample_id", F.inline(rows))


def rfpp(tok: DataFrame, gamma: float) -> DataFrame:
    """Discounted return that restarts behind masked tokens, whitened over valid tokens."""
    def step(inside, reward, mask):
        returns, ahead = np.zeros_like(reward), np.zeros(len(reward))
        for t in range(reward.shape[1] - 1, -1, -1):
            now = reward[:, t] + gamma * ahead
            returns[:, t] = now
            ahead = np.where(inside[:, t], now * mask[:, t], 0.0)
        return returns

    out = _scan(tok, ["reward", "mask"], "returns", step)
    return whiten(out, "returns", "advantage").withColumn("advantage", F.col("advantage") * F.col("mask"))


def gae(tok: DataFrame, gamma: float, lam: float, value: str = "value_est") -> DataFrame:
    """Generalised advantages that skip observation tokens; returns; advantages whitened."""
    def step(inside, reward, mask, estimate):
        raw = np.zeros_like(reward)
        next_value, ahead = np.zeros(len(reward)), np.zeros(len(reward))
        for t in range(reward.shape[1] - 1, -1, -1):
            live = inside[:, t] & (mask[:, t] != 0)
            candidate = reward[:, t] + gamma * next_value - estimate[:, t] + gamma * lam * ahead
            next_value = np.where(live, estimate[:, t], next_value)
            ahead = np.where(live, candidate, ahead)
            raw[:, t] = ahead
        return raw

    out = _scan(tok, ["reward", "mask", value], "raw", step).withColumn("returns", F.col("raw") + F.col(value))
    return whiten(out, "raw", "advantage").drop("raw")


def optimal_token_baseline(
    tok: DataFrame, weight: str | None = None, compact: bool = False, zero_tail: bool = True, eps: float = 1e-8
) -> DataFrame:
    """Reward to go minus the variance-weighted baseline of the prompt at each position.

    Needs ``old_logp`` and ``sum_pi_squared``; ``weight`` is an optional importance weight column.
    With ``compact`` positions count valid tokens only, as for several turns in one sequence.
    """
    mask = F.col("mask")
    energy = 1 - 2 * F.exp("old_logp") + F.col("sum_pi_squared")
    if weight:
        energy = energy * F.col(weight) * F.col(weight)
    staged = tok.withColumns(
        {
            "returns": F.sum(F.col("reward") * mask).over(_backward()),
            "__w": F.sum(energy * mask).over(_forward()),
            "__valid": F.sum(mask).over(_forward()),
            "__len": F.sum(mask).over(W.partitionBy("sample_id")),
        }
    )
    position = F.col("__valid") if compact else F.col("t")
    staged = staged.withColumn("__at", F.when(mask != 0, position).otherwise(-F.col("t")) if compact else position)
    live = F.when(mask != 0, F.col("__w")).otherwise(0.0)
    # Lengths of the sequences of each prompt: distinct lengths are bounded by the response length.
    lengths = tok.groupBy("uid", "sample_id").agg(F.sum("mask").alias("len"), F.count(F.lit(1)).alias("rows"))
    if compact:
        lengths = lengths.where("len > 0")
    longest = (
        lengths.groupBy("uid", "len")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"))
        .groupBy("uid")
        .agg(F.sum("n").alias("__n"), F.sum("rows").alias("__rows"), F.sort_array(F.collect_list(F.struct("len", "n")), asc=False).alias("__l"))
        .select(
            "uid", "__n", "__rows", F.col("__l")[0]["len"].alias("__max"),
            F.when((F.col("__l")[0]["n"] == 1) & (F.size("__l") > 1), F.col("__l")[1]["len"]).alias("__second"),
        )
    )
    based = attach_stats(
        staged, ["uid", "__at"], {"__num": F.sum(F.col("returns") * live), "__den": F.sum(live)}, "sample_id"
    )
    based = attach_lookup(based, longest, "uid", "sample_id", rows="__rows")
    tail = (F.col("__len") == F.col("__max")) & F.col("__second").isNotNull() & (F.col("__at") > F.col("__second"))
    base = F.when(F.col("__n") > 1, F.col("__num") / (F.col("__den") + eps)).otherwise(0.0)
    if zero_tail:
        base = F.when(tail, 0.0).otherwise(base)
    out = based.withColumn("advantage", F.when(mask != 0, F.col("returns") - base).otherwise(0.0))
    return out.drop("__w", "__valid", "__at", "__num", "__den", "__len", "__n", "__max", "__second")
