"""Off-policy diagnostics, divergences, losses and masks on token rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions import constants as K
from trailmark.operators.ordering import running, with_value_bucket


def live(value: Column, mask: str = "mask") -> Column:
    """The value on valid tokens, 0 elsewhere (also when it is NaN there)."""
    return F.when(F.col(mask) != 0, value).otherwise(0.0)


def masked_sum(value: Column, mask: str = "mask") -> Column:
    return F.sum(live(value, mask))


def masked_mean(value: Column, mask: str = "mask") -> Column:
    return masked_sum(value, mask) / (F.sum(mask) + 1e-8)


def masked_stats(tok: DataFrame, value: str, mask: str = "mask") -> DataFrame:
    """Masked sum, mean and unbiased variance of a column; fewer than two valid tokens is an error."""
    n = F.col("n")
    kept = F.when(F.col(mask) != 0, F.col(value))
    out = tok.agg(
        F.sum(mask).alias("n"), masked_sum(F.col(value), mask).alias("masked_sum"), masked_mean(F.col(value), mask).alias("masked_mean"),
        F.avg(kept).alias("__m"), (F.var_pop(kept) * F.count(kept)).alias("__ss"),
    )
    checked = F.when(n >= 2, unbiased_variance(n, F.col("__m"), F.col("__ss"))).otherwise(
        F.raise_error(F.lit("a masked variance needs two valid tokens")).cast("double")
    )
    return out.withColumn("masked_var", checked).drop("__m", "__ss")


def unbiased_variance(n: Column, mean: Column, squares: Column) -> Column:
    """Variance from a count, a mean and the squared deviations from it.

    The mean divides by n + 1e-8, which shifts the centre a little; the shift is added back.
    """
    shift = mean - mean * n / (n + 1e-8)
    return (squares + n * shift * shift) / (n + 1e-8) * n / (n - 1)


def kl(logp: Column, ref: Column, kind: str) -> Column:
    """Divergence estimate per token."""
    diff = logp - ref
    if kind in ("kl", "k1"):
        return diff
    if kind == "abs":
        return F.abs(diff)
    if kind in ("mse", "k2"):
        return 0.5 * diff * diff
    if kind in ("low_var_kl", "k3"):
        gap = clamp(-diff, -20.0, 20.0)
        return clamp(F.exp(gap) - gap - 1, -10.0, 10.0)
    raise ValueError(f"unknown divergence {kind!r}")


def clamp(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def apply_kl(tok: DataFrame, beta: float, kind: str = "k1", logp: str = "old_logp", ref: str = "ref_logp") -> DataFrame:
    """Token rewards lowered by the masked divergence."""
    penalty = live(kl(F.col(logp), F.col(ref), kind))
    return tok.withColumns({"kl": penalty, "penalised_reward": F.col("reward") - beta * penalty})


def mean_sequence_kl(penalised: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over sequences of the mean divergence over valid tokens."""
    per_sequence = penalised.groupBy(*by, "sample_id").agg(masked_mean(F.col("kl")).alias("k"))
    return per_sequence.groupBy(*by).agg(F.avg("k").alias("mean_kl"))


def kl_schedule(steps: DataFrame, init: float, target: float, horizon: float, signed: bool = True) -> DataFrame:
    """Coefficient before and after each step: each step multiplies it by a clipped relative error.

    The running product is a running sum of logarithms; signs and zeros are counted apart. A step of more than
    ``horizon / 0.2`` sequences can have a negative factor: the coefficient then changes its sign or, unless
    ``signed``, is no number from there on.
    """
    factor = 1 + clamp(F.col("kl") / target - 1, -0.2, 0.2) * F.col("n") / horizon
    staged = with_value_bucket(steps.withColumn("__f", factor), "step")
    out = running(
        staged, [], "__bucket", [F.col("step")],
        {
            "__log": F.when(F.col("__f") != 0, F.log(F.abs("__f"))).otherwise(0.0),
            "__neg": (F.col("__f") < 0).cast("int"),
            "__zero": (F.col("__f") == 0).cast("int"),
        },
    )
    size = F.when(F.col("__zero") > 0, 0.0).otherwise(init * F.exp("__log"))
    turned = F.when(F.col("__neg") % 2 == 1, -size).otherwise(size) if signed else F.lit(float("nan"))
    after = F.when(F.col("__neg") > 0, turned).otherwise(size)
    return out.withColumn("coefficient", after).drop("__f", "__log", "__neg", "__zero", "__bucket")


LOSS_MODES = ["token-mean", "seq-mean-token-sum", "seq-mean-token-sum-norm", "seq-mean-token-mean"]


def aggregate_loss(tok: DataFrame, loss: str, mode: str, scale: int | None = None) -> DataFrame:
    """One loss value; sequences without a valid token do not count."""
    if mode == "token-mean":
        return tok.agg((masked_sum(F.col(loss)) / F.sum("mask")).alias("loss"))
    if mode not in LOSS_MODES:
        raise ValueError(f"unknown loss mode {mode!r}")
    sequences = tok.groupBy("sample_id").agg(
        masked_sum(F.col(loss)).alias("s"), F.sum("mask").alias("n"), F.max("t").alias("width")
    )
    used = F.col("n") > 0
    if mode == "seq-mean-token-mean":
        return sequences.agg(F.avg(F.when(used, F.col("s") / (F.col("n") + 1e-8))).alias("loss"))
    mean = F.avg(F.when(used, F.col("s")))
    if mode == "seq-mean-token-sum-norm":
        mean = mean / (F.lit(scale) if scale is not None else F.max("width"))
    return sequences.agg(mean.alias("loss"))


def log_ratio() -> Column:
    return F.col("old_logp") - F.col("rollout_logp")


def bounded(value: Column) -> Column:
    return clamp(value, -K.LOG_RATIO_BOUND, K.LOG_RATIO_BOUND)


def offpolicy_metrics(tok: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Perplexities, divergences and chi-squared of rollout against training policy.

    One aggregation per sequence carries the token sums along, so tokens are shuffled once.
    """
    ratio = log_ratio()
    sequences = tok.groupBy(*by, "sample_id").agg(
        masked_mean(F.col("old_logp")).alias("train"),
        masked_mean(F.col("rollout_logp")).alias("roll"),
        F.sum("mask").alias("n"),
        masked_sum(-ratio).alias("kl_sum"),
        masked_sum(F.exp(ratio) - ratio - 1).alias("k3_sum"),
        masked_sum(F.exp(2 * bounded(ratio))).alias("rho2_sum"),
        masked_sum(ratio).alias("ratio_sum"),
    )
    gap = F.col("roll") - F.col("train")
    tokens = F.sum("n") + 1e-8
    return sequences.groupBy(*by).agg(
        F.avg(F.exp(-F.col("train"))).alias("training_ppl"),
        F.avg(-F.col("train")).alias("training_log_ppl"),
        (F.sum("kl_sum") / tokens).alias("kl"),
        (F.sum("k3_sum") / tokens).alias("k3_kl"),
        F.avg(F.exp(-F.col("roll"))).alias("rollout_ppl"),
        F.avg(-F.col("roll")).alias("rollout_log_ppl"),
        F.avg(gap).alias("log_ppl_diff"),
        F.avg(F.abs(gap)).alias("log_ppl_abs_diff"),
        F.max(gap).alias("log_ppl_diff_max"),
        F.min(gap).alias("log_ppl_diff_min"),
        F.avg(F.exp(gap)).alias("ppl_ratio"),
        (F.sum("rho2_sum") / tokens - 1).alias("chi2_token"),
        (F.avg(F.exp(2 * bounded(F.col("ratio_sum")))) - 1).alias("chi2_seq"),
    )


def _sequence() -> W:
    return W.partitionBy("sample_id")


def is_weights(tok: DataFrame, level: str, threshold: float, normalise: bool = False) -> DataFrame:
    """Truncated importance weights per token, or one per sequence; optionally scaled to mean one."""
    if level not in ("token", "sequence"):
        raise ValueError(f"level must be token or sequence, not {level!r}")
    raw = log_ratio() if level == "token" else F.sum(live(log_ratio())).over(_sequence())
    weight = F.exp(bounded(F.col("log_weight")))
    out = tok.withColumn("log_weight", raw).withColumn(
        "weight", live(F.when(weight > threshold, threshold).otherwise(weight))
    )
    if not normalise:
        return out
    if level == "token":
        mean = out.agg(masked_mean(F.col("weight"))).scalar()
    else:
        per_sequence = out.groupBy("sample_id").agg(masked_mean(F.col("weight")).alias("w"), F.sum("mask").alias("n"))
        mean = per_sequence.agg(F.avg(F.when(F.col("n") > 0, F.col("w")))).scalar()
    return out.withColumn("weight", F.when(mean > 1e-8, F.col("weight") / mean).otherwise(F.col("weight")))


def weight_stats(weighted: DataFrame, threshold: float, level: str = "token") -> DataFrame:
    """Mean, spread, effective sample size and extremes of importance weights."""
    low = 1.0 / threshold
    # The weights before truncation, so that those beyond the threshold still show.
    w = live(F.exp(bounded(F.col("log_weight"))))
    bounded_w = clamp(w, low, threshold)
    valid = F.col("mask") != 0
    sequences = weighted.groupBy("sample_id").agg(
        F.sum("mask").alias("n"),
        masked_sum(w).alias("s"),
        masked_sum(bounded_w).alias("bs"),
        masked_sum(bounded_w * bounded_w).alias("bq"),
        F.max(F.when(valid, w)).alias("hi"),
        F.min(F.when(valid, w)).alias("lo"),
        F.count(F.when(valid & (w > threshold), 1)).alias("above"),
        F.count(F.when(valid & (w < low), 1)).alias("below"),
        F.first("log_weight").alias("log_weight"),
    )
    tokens = F.sum("n") + 1e-8
    mean, square = F.sum("bs") / tokens, F.sum("bq") / tokens
    per_sequence = F.col("s") / (F.col("n") + 1e-8)
    log_w = F.col("log_weight")
    if level == "sequence":
        edges = {
            "rollout_is_max": F.exp(F.least(F.max(log_w), F.lit(K.LOG_RATIO_BOUND))),
            "rollout_is_min": F.exp(F.min(log_w)),
            "rollout_is_ratio_fraction_high": F.avg((log_w > math.log(threshold)).cast("double")),
            "rollout_is_ratio_fraction_low": F.avg((log_w < math.log(low)).cast("double")),
        }
    else:
        edges = {
            "rollout_is_max": F.max("hi"),
            "rollout_is_min": F.min("lo"),
            "rollout_is_ratio_fraction_high": F.sum("above") / tokens,
            "rollout_is_ratio_fraction_low": F.sum("below") / tokens,
        }
    variance = square - mean * mean
    normalised = mean + 1e-8
    return sequences.agg(
        (F.sum("s") / tokens).alias("rollout_is_mean"),
        *[c.alias(n) for n, c in edges.items()],
        F.when(F.sum("n") > 1, F.sqrt(F.when(variance > 0, variance).otherwise(0.0))).otherwise(0.0).alias("rollout_is_std"),
        (1.0 / (square / (normalised * normalised))).alias("rollout_is_eff_sample_size"),
        F.avg(per_sequence).alias("rollout_is_seq_mean"),
        F.coalesce(F.stddev_samp(per_sequence), F.lit(0.0)).alias("rollout_is_seq_std"),
        F.max(per_sequence).alias("rollout_is_seq_max"),
        F.min(per_sequence).alias("rollout_is_seq_min"),
        F.max(F.abs(per_sequence - 1.0)).alias("rollout_is_seq_max_deviation"),
        F.avg((per_sequence > threshold).cast("double")).alias("rollout_is_seq_fraction_high"),
        F.avg((per_sequence < low).cast("double")).alias("rollout_is_seq_fraction_low"),
    )


REJECTION_OPTIONS = [
    "token_k1", "token_k2", "token_k3", "seq_sum_k1", "seq_sum_k2", "seq_sum_k3",
    "seq_mean_k1", "seq_mean_k2", "seq_mean_k3", "seq_max_k2", "seq_max_k3",
]


def thresholds(options: Sequence[str], spec: str | float) -> dict[str, tuple[float | None, float]]:
    """Lower and upper bound per option from one shared or one text per option.

    A ``k1`` option takes ``lower_upper`` or an upper bound with its reciprocal, both as ratios (the
    bounds returned are their logarithms); the others take a single upper bound.
    """
    unknown = [o for o in options if o not in REJECTION_OPTIONS]
    if unknown:
        raise ValueError(f"unknown rejection options {unknown}")
    given = [part.strip() for part in str(spec).split(",") if part.strip()]
    if len(given) not in (1, len(options)):
        raise ValueError(f"expected one threshold or {len(options)}, got {len(given)}")
    given = given * len(options) if len(given) == 1 else given
    out: dict[str, tuple[float | None, float]] = {}
    for option, text in zip(options, given):
        bounds = [float(b) for b in text.split("_", 1)]
        if min(bounds) <= 0:
            raise ValueError(f"thresholds of {option} must be positive: {text}")
        if option.endswith("k1"):
            low, high = bounds if len(bounds) == 2 else (1.0 / bounds[0], bounds[0])
            out[option] = (math.log(low), math.log(high))
        elif len(bounds) == 2:
            raise ValueError(f"{option} takes a single upper bound: {text}")
        else:
            out[option] = (None, bounds[0])
    return out


def divergence(option: str) -> Column:
    """The statistic of a rejection option on every token; sequence options repeat their value."""
    ratio = bounded(log_ratio())
    token = {"k1": -ratio, "k2": 0.5 * ratio * ratio, "k3": F.exp(ratio) - 1.0 - ratio}[option[-2:]]
    if option.startswith("token"):
        return token
    if option.startswith("seq_sum"):
        return F.sum(live(token)).over(_sequence())
    if option.startswith("seq_mean"):
        return F.sum(live(token)).over(_sequence()) / (F.sum("mask").over(_sequence()) + 1e-8)
    return F.coalesce(F.max(F.when(F.col("mask") != 0, token)).over(_sequence()), F.lit(0.0))


def rejection_mask(tok: DataFrame, options: Sequence[str], spec: str | float) -> DataFrame:
    """Adds ``keep_<option>`` flags and ``new_mask``: tokens every option accepts."""
    options = list(dict.fromkeys(options))
    bounds = thresholds(options, spec)
    out = tok.withColumns({f"stat_{o}": divergence(o) for o in options})
    keep = {}
    for option, (low, high) in bounds.items():
        inside = F.col(f"stat_{option}") <= high
        keep[f"keep_{option}"] = inside if low is None else inside & (F.col(f"stat_{option}") >= low)
    out = out.withColumns(keep)
    accepted = F.lit(True)
    for option in options:
        accepted = accepted & F.col(f"keep_{option}")
    return out.withColumn("new_mask", F.when(accepted, F.col("mask")).otherwise(0))


def rejection_fractions(masked: DataFrame, options: Sequence[str]) -> DataFrame:
    """Share of tokens and of sequences each option, and all together, reject."""
    valid = F.col("mask") != 0
    names = {**{o: ~F.col(f"keep_{o}") for o in options}, "all": F.col("new_mask") == 0}
    sequences = masked.groupBy("sample_id").agg(
        F.sum("mask").alias("n"), *[F.count(F.when(valid & hit, 1)).alias(name) for name, hit in names.items()]
    )
    lines = F.array(*[F.struct(F.lit(name).alias("option"), F.col(name).alias("hit")) for name in names])
    return (
        sequences.select("n", F.inline(lines))
        .groupBy("option")
        .agg(
            (F.sum("hit") / (F.sum("n") + 1e-8)).alias("masked_fraction"),
            F.when(F.col("option") == "all", F.avg((F.col("hit") > 0).cast("double")))
            .otherwise(F.coalesce(F.avg(F.when(F.col("n") > 0, (F.col("hit") > 0).cast("double"))), F.lit(0.0)))
            .alias("seq_masked_fraction"),
        )
    )


def rejection_stats(tok: DataFrame, option: str, spec: str | float) -> DataFrame:
    """Mean, extremes, fractions beyond the bounds and clamped spread of an option's statistic."""
    low, high = thresholds([option], spec)[option]
    floor = 0.0 if low is None else low
    stat, valid = F.col("stat"), F.col("mask") != 0
    held = clamp(stat, floor, high)
    by_sequence = not option.startswith("token")
    sequences = tok.withColumn("stat", divergence(option)).groupBy("sample_id").agg(
        F.sum("mask").alias("n"), masked_sum(stat).alias("s"), masked_sum(held).alias("hs"), masked_sum(held * held).alias("hq"),
        F.max(F.when(valid, stat)).alias("hi"), F.min(F.when(valid, stat)).alias("lo"),
        F.count(F.when(valid & (stat > high), 1)).alias("above"), F.count(F.when(valid & (stat < floor), 1)).alias("below"),
        F.first("stat").alias("whole"),
    ).withColumn("seq", F.when(F.col("n") > 0, F.col("whole") if by_sequence else F.col("s") / (F.col("n") + 1e-8)))
    tokens = F.sum("n") + 1e-8
    seq = F.col("seq")
    seq_high, seq_low = F.avg((seq > high).cast("double")), F.avg((seq < floor).cast("double"))
    mean = F.sum("hs") / tokens
    variance = F.sum("hq") / tokens - mean * mean
    return sequences.agg(
        F.lit(option).alias("option"),
        (F.sum("s") / tokens).alias("mean"),
        (F.max(seq) if by_sequence else F.max("hi")).alias("max"),
        (F.min(seq) if by_sequence else F.min("lo")).alias("min"),
        (seq_high if by_sequence else F.sum("above") / tokens).alias("fraction_high"),
        (F.lit(0.0) if low is None else (seq_low if by_sequence else F.sum("below") / tokens)).alias("fraction_low"),
        F.when(F.sum("n") > 1, F.sqrt(F.when(variance > 0, variance).otherwise(0.0))).otherwise(0.0).alias("std"),
        F.coalesce(F.avg(seq), F.lit(0.0)).alias("seq_mean"),
        F.coalesce(F.stddev_samp(seq), F.lit(0.0)).alias("seq_std"),
        F.coalesce(F.max(seq), F.lit(0.0)).alias("seq_max"),
        F.coalesce(F.min(seq), F.lit(0.0)).alias("seq_min"),
        F.coalesce(F.max(F.abs(seq)), F.lit(0.0)).alias("seq_max_deviation"),
        F.coalesce(seq_high, F.lit(0.0)).alias("seq_fraction_high"),
        (F.lit(0.0) if low is None else F.coalesce(seq_low, F.lit(0.0))).alias("seq_fraction_low"),
    )


def prob_agreement(tok: DataFrame) -> DataFrame:
    """Largest, mean and spread of the probability gap, and Pearson correlation, on valid tokens."""
    actor, roll = F.exp("old_logp"), F.exp("rollout_logp")
    gap = F.abs(actor - roll)
    return tok.where("mask != 0").agg(
        F.max(gap).alias("diff_max"), F.avg(gap).alias("diff_mean"), F.stddev_samp(gap).alias("diff_std"), F.corr(actor, roll).alias("pearson")
    )


def token_diff(tok: DataFrame, a: str, b: str) -> DataFrame:
    """Valid tokens per sequence on which two columns differ."""
    return tok.groupBy("sample_id").agg(F.count(F.when((F.col(a) != F.col(b)) & (F.col("mask") == 1), 1)).alias("n_diff"))


def variance_proxy(tok: DataFrame, advantage: str, grad_norm: float | None = None, weight: str | None = None) -> DataFrame:
    """Proxies of the gradient variance from squared advantages and score-norm sums."""
    energy = 1 - 2 * F.exp("old_logp") + F.col("sum_pi_squared")
    scaled = energy if weight is None else energy * F.col(weight) * F.col(weight)
    original = energy if weight is None else scaled / F.greatest(F.col(weight) * F.col(weight), F.lit(1e-10))
    sequences = tok.groupBy("sample_id").agg(
        masked_mean(F.col(advantage)).alias("a"), masked_sum(scaled).alias("w"), masked_sum(original).alias("wo"),
        (masked_mean(F.col(weight)) if weight else F.lit(1.0)).alias("rho"),
    )
    a2 = F.col("a") * F.col("a")
    power = F.avg(F.col("rho") * F.col("rho") * a2 * F.when(F.col("wo") > 0, F.col("wo")).otherwise(0.0))
    signal = None if grad_norm is None else grad_norm**2
    noise = F.lit(0.0) if signal is None else F.when(
        F.count(F.lit(1)) > 1, F.greatest(F.lit(0.0), (power - signal) / (F.count(F.lit(1)) - 1))
    ).otherwise(0.0)
    return sequences.agg(
        F.lit(0.0 if signal is None else signal).alias("signal_strength"), power.alias("total_power"), noise.alias("pure_noise"),
        F.avg(a2).alias("expected_a_squared"), F.avg("w").alias("expected_w"),
    )
