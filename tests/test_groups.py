"""Ranks, samples, advantages and diagnostics against brute force, with a key that holds a third of the rows."""

import hashlib
import math
from bisect import bisect_right
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailmark.operators import advantages as G
from trailmark.operators import builders as D
from trailmark.operators import evaluation as V
from trailmark.operators import ordering as O
from trailmark.operators import policy as P
from trailmark.operators import profiles
from trailmark.operators import sampling as H
from trailmark.operators.groups import attach_stats
from trailmark.plans import QUERIES, load_all
from trailmark.plans.building import trajectories

load_all()

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def samples():
    n = 600
    uid = np.where(RNG.random(n) < 1 / 3, "hot", [f"g{i % 90}" for i in range(n)])
    uid[0] = "lone"
    return pd.DataFrame({"sample_id": range(n), "uid": uid, "score": RNG.integers(0, 9, n) / 3.0, "n_tokens": RNG.integers(1, 40, n)})


@pytest.fixture(scope="module")
def tokens():
    rows = []
    for s in range(60):
        for t in range(1, RNG.integers(1, 12) + 1):
            rows.append((s, t, "hot" if s % 3 == 0 else f"g{s % 7}", int(RNG.random() < 0.7)))
    df = pd.DataFrame(rows, columns=["sample_id", "t", "uid", "mask"])
    for c in ("reward", "value_est"):
        df[c] = RNG.normal(size=len(df))
    for c in ("old_logp", "rollout_logp"):
        df[c] = -RNG.random(len(df)) * 2
    df["sum_pi_squared"] = RNG.random(len(df))
    return df


def spark_frame(spark, df):
    return spark.createDataFrame(df.astype({"mask": "int32", "t": "int32"}) if "mask" in df else df)


def by_id(df, column="advantage"):
    return df.select("sample_id", column).toPandas().set_index("sample_id")[column].sort_index()


def test_attach_stats_equals_transform(spark, samples):
    got = by_id(attach_stats(spark.createDataFrame(samples), ["uid"], {"m": F.avg("score")}, "sample_id"), "m")
    want = samples.groupby("uid").score.transform("mean")
    assert got.to_numpy() == pytest.approx(want.to_numpy())


def test_attach_stats_keeps_null_keys(spark):
    rows = spark.createDataFrame([(1, None, 1.0), (2, None, 3.0), (3, "a", 5.0)], "sample_id int, uid string, score double")
    assert by_id(attach_stats(rows, ["uid"], {"m": F.avg("score")}, "sample_id"), "m").tolist() == [2.0, 2.0, 5.0]


def test_group_advantages(spark, samples):
    df = spark.createDataFrame(samples)
    g = samples.groupby("uid").score
    n, mean, std = g.transform("count"), g.transform("mean"), g.transform("std").fillna(1.0)
    mean0 = mean.where(n > 1, 0.0)
    s = samples.score
    assert by_id(G.grpo(df)).to_numpy() == pytest.approx(((s - mean0) / (std.where(n > 1, 1.0) + 1e-6)).to_numpy())
    others = (mean * n - s) / (n - 1)
    assert by_id(G.rloo(df)).to_numpy() == pytest.approx((s - others).where(n > 1, s).to_numpy())
    assert by_id(G.rloo(df, singleton="zero")).to_numpy() == pytest.approx((s - others).where(n > 1, 0.0).to_numpy())
    weighted = (s * samples.n_tokens).groupby(samples.uid).transform("sum") / samples.n_tokens.groupby(samples.uid).transform("sum")
    assert by_id(G.opo(df)).to_numpy() == pytest.approx((s - weighted.where(n > 1, 0.0)).to_numpy())
    assert by_id(G.gpg(df)).to_numpy() == pytest.approx((len(s) / (s != 0).sum() * (s - mean0)).to_numpy())
    centred = np.repeat((s - mean0).to_numpy(), samples.n_tokens)
    white = ((s - mean0) - centred.mean()) / np.sqrt(centred.var(ddof=1) + 1e-8)
    assert by_id(G.rfpp_baseline(df)).to_numpy() == pytest.approx(white.to_numpy())


def test_pass_at_k(spark, samples):
    many = samples[samples.groupby("uid").uid.transform("count") > 1]
    got = by_id(G.grpo_passk(spark.createDataFrame(many)))
    for _, rows in many.groupby("uid"):
        top = rows.sort_values(["score", "sample_id"], ascending=[False, True])
        want = (top.score.iloc[0] - top.score.iloc[1]) / (rows.score.std() + 1e-6)
        assert got[top.sample_id.iloc[0]] == pytest.approx(want)
        assert (got[top.sample_id.iloc[1:]] == 0).all()
    with pytest.raises(Exception, match="a group needs two samples"):
        G.grpo_passk(spark.createDataFrame(samples)).collect()


def token_values(df, column):
    return df.select("sample_id", "t", column).toPandas().set_index(["sample_id", "t"])[column].sort_index()


def whitened(values, mask):
    kept = values[mask != 0]
    return (values - kept.mean()) / np.sqrt(kept.var(ddof=1) + 1e-8)


def test_gae_and_discounted_returns(spark, tokens):
    df, gamma, lam = spark_frame(spark, tokens), 0.9, 0.8
    adv, ret = [], []
    for _, seq in tokens.sort_values(["sample_id", "t"]).groupby("sample_id"):
        nxt = last = run = 0.0
        a, r = [], []
        for _, row in seq[::-1].iterrows():
            candidate = row.reward + gamma * nxt - row.value_est + gamma * lam * last
            nxt = row.value_est if row["mask"] else nxt
            last = candidate if row["mask"] else last
            a.append(last)
            run = row.reward + gamma * run
            r.append(run)
            run = run * row["mask"]
        adv += a[::-1]
        ret += r[::-1]
    ordered = tokens.sort_values(["sample_id", "t"])
    mask, adv, ret = ordered["mask"].to_numpy(), np.array(adv), np.array(ret)
    got = G.gae(df, gamma, lam)
    assert token_values(got, "returns").to_numpy() == pytest.approx(adv + ordered.value_est.to_numpy())
    assert token_values(got, "advantage").to_numpy() == pytest.approx(whitened(adv, mask))
    got = G.rfpp(df, gamma)
    assert token_values(got, "returns").to_numpy() == pytest.approx(ret)
    assert token_values(got, "advantage").to_numpy() == pytest.approx(whitened(ret, mask) * mask)


@pytest.mark.parametrize("compact", [False, True])
def test_optimal_token_baseline(spark, tokens, compact):
    width = tokens.t.max()
    ids = sorted(tokens.sample_id.unique())
    grid = {c: np.zeros((len(ids), width)) for c in ("reward", "old_logp", "sum_pi_squared", "mask")}
    for row in tokens.itertuples():
        for c in grid:
            grid[c][ids.index(row.sample_id), row.t - 1] = getattr(row, c)
    mask = grid["mask"]
    returns = np.cumsum((grid["reward"] * mask)[:, ::-1], axis=1)[:, ::-1]
    energy = np.cumsum((1 - 2 * np.exp(grid["old_logp"]) + grid["sum_pi_squared"]) * mask, axis=1)
    want = np.zeros_like(returns)
    uid = tokens.groupby("sample_id").uid.first()
    lengths = mask.sum(axis=1).astype(int)
    for name in uid.unique():
        members = [i for i, s in enumerate(ids) if uid[s] == name and (lengths[i] > 0 or not compact)]
        place = {i: np.flatnonzero(mask[i]) if compact else np.arange(width) for i in members}
        size = max((len(p) for p in place.values()), default=0)
        num, den = np.zeros(size), np.zeros(size)
        for i in members:
            p = place[i]
            num[: len(p)] += returns[i, p] * energy[i, p] * mask[i, p]
            den[: len(p)] += energy[i, p] * mask[i, p]
        ranked = sorted((lengths[i] for i in members), key=lambda n: -n)
        for i in members:
            base = num / (den + 1e-8) if len(members) > 1 else np.zeros(size)
            if len(members) > 1 and lengths[i] == ranked[0] and ranked[0] > ranked[1]:
                base = base.copy()
                base[ranked[1] :] = 0.0
            p = place[i]
            want[i, p] = (returns[i, p] - base[: len(p)]) * mask[i, p]
    got = token_values(G.optimal_token_baseline(spark_frame(spark, tokens), compact=compact), "advantage")
    for (s, t), value in got.items():
        assert value == pytest.approx(want[ids.index(s), t - 1], abs=1e-9)


def test_response_mask_examples(spark):
    sequences = [[20, 10, 34, 1, 0, 0, 0], [78, 0, 76, 2, 1, 0, 0], [23, 98, 1, 0, 0, 0, 0], [33, 3, 98, 45, 1, 0, 0]]
    rows = [(s, t + 1, x) for s, seq in enumerate(sequences) for t, x in enumerate(seq)]
    df = spark.createDataFrame(rows, "sample_id int, t int, token_id int")
    lengths = lambda eos: [r.n for r in G.response_mask(df, eos).groupBy("sample_id").agg(F.sum("response_mask").alias("n")).orderBy("sample_id").collect()]
    assert lengths([1]) == [4, 5, 3, 5]
    assert lengths([1, 2]) == [4, 4, 3, 5]


def test_offpolicy_and_rejection(spark, tokens):
    df = spark_frame(spark, tokens)
    ratio = tokens.old_logp - tokens.rollout_logp
    kept = tokens["mask"] != 0
    got = P.offpolicy_metrics(df).first()
    assert got.kl == pytest.approx((-ratio)[kept].mean())
    assert got.chi2_token == pytest.approx((np.exp(ratio) ** 2)[kept].mean() - 1)
    sums = (ratio * tokens["mask"]).groupby(tokens.sample_id).sum()
    assert got.chi2_seq == pytest.approx((np.exp(2 * sums)).mean() - 1)
    masked = P.rejection_mask(df, ["token_k1", "seq_sum_k1"], "2.0, 0.5_4")
    ok = (-ratio).between(-np.log(2), np.log(2)) & (-sums).between(np.log(0.5), np.log(4)).reindex(tokens.sample_id).to_numpy()
    want = tokens.assign(new=(tokens["mask"] * ok)).set_index(["sample_id", "t"]).new.sort_index()
    assert (token_values(masked, "new_mask") == want).all()


def test_threshold_texts():
    assert P.thresholds(["token_k1"], 2.0)["token_k1"] == pytest.approx((np.log(0.5), np.log(2)))
    assert P.thresholds(["token_k2", "seq_max_k3"], "1,2") == {"token_k2": (None, 1.0), "seq_max_k3": (None, 2.0)}
    for options, spec in ((["token_k2"], "1_2"), (["token_k2", "token_k3", "seq_sum_k2"], "1,2"), (["token_k1"], "-1"), (["other"], "1")):
        with pytest.raises(ValueError):
            P.thresholds(options, spec)


def test_importance_weights_are_truncated_and_scaled(spark, tokens):
    df = spark_frame(spark, tokens)
    raw = np.exp(tokens.old_logp - tokens.rollout_logp) * tokens["mask"]
    want = raw.clip(upper=1.5)
    got = token_values(P.is_weights(df, "token", 1.5), "weight")
    ordered = tokens.assign(w=want).set_index(["sample_id", "t"]).w.sort_index()
    assert got.to_numpy() == pytest.approx(ordered.to_numpy())
    scaled = token_values(P.is_weights(df, "token", 1.5, True), "weight")
    assert scaled[ordered > 0].mean() == pytest.approx(1.0)


@pytest.mark.parametrize("steps", [[(1, 0.5, 10), (2, 0.001, 10), (3, 0.02, 10)]])
def test_kl_schedule(spark, steps):
    want, value = [], 0.2
    for _, kl, n in steps:
        value *= 1 + np.clip(kl / 0.02 - 1, -0.2, 0.2) * n / 100
        want.append(value)
    df = spark.createDataFrame(steps, "step int, kl double, n int")
    got = [r.coefficient for r in P.kl_schedule(df, 0.2, 0.02, 100).orderBy("step").collect()]
    assert got == pytest.approx(want)


def test_ranks_with_clustered_values_and_a_hot_group(spark):
    n = 500
    values = np.concatenate([np.arange(n - 1), [2**60]])
    df = spark.createDataFrame(pd.DataFrame({"k": values, "g": np.where(np.arange(n) % 3 == 0, "hot", [f"g{i % 50}" for i in range(n)])}))
    got = O.ranked_by_value(df, "k").toPandas().sort_values("k")
    assert got["rank"].tolist() == list(range(1, n + 1))
    got = O.ranked_by_hash(df, 7, "k", ["g"]).withColumn("h", O.seed_hash(7, "k")).toPandas()
    want = got.groupby("g").h.rank().astype(int)
    assert (got["rank"] == want).all()


def test_percentiles_with_a_value_that_holds_a_third(spark):
    values = np.where(RNG.random(1001) < 1 / 3, 7.0, RNG.normal(size=1001))
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    row = profiles.percentile_row(df, "v", [0.0, 0.5, 0.9, 0.99, 1.0]).first()
    assert list(row) == pytest.approx(np.percentile(values, [0, 50, 90, 99, 100]).tolist())


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 40).cast("string"))))
    picked = {r.id for r in H.sample_n(df, 37, 1, "id").collect()}
    assert len(picked) == 37 and picked == {r.id for r in H.sample_n(df.repartition(3), 37, 1, "id").collect()}
    assert H.sample_n(df, 5000, 1, "id").count() == 1000
    capped = H.cap_per_class(df, "c", 5, 1, "id").toPandas().c.value_counts()
    assert capped.max() == 5 and len(capped) == 41
    split = H.split_count(df, 0.0001, 1, "id").toPandas().split.value_counts()
    assert split["val"] == 1 and split["train"] == 999


def test_uneven_splits_are_errors(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    with pytest.raises(Exception, match="cannot split into equal parts"):
        H.split_equal(df, 3, "k").collect()
    with pytest.raises(Exception, match="rows do not fill the last batch"):
        H.assign_batches(df, 4, 1, 1, "k").collect()
    with pytest.raises(Exception, match="not enough rows in the pool"):
        H.replay_sample(df, "k", 5, 6, 1).collect()


def test_union_columns_rejects_a_difference(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert H.union_columns(a, a.withColumn("w", F.lit(1)), "k").count() == 2
    with pytest.raises(Exception, match="column v differs"):
        H.union_columns(a, a.withColumn("v", F.lit("y")), "k").collect()


@pytest.mark.parametrize("rows", [200, 3000])
def test_batches_of_any_size_take_one_way(spark, rows):
    df = spark.range(rows).select(F.lit(1).alias("b"), F.col("id"), (F.col("id") % 17 + 1).cast("int").alias("n"))
    out = H.balance(df, "b", "id", "n", 4, equal=True).toPandas()
    assert len(out) == rows and out.shard.value_counts().tolist() == [rows // 4] * 4
    sums = out.groupby("shard").n.sum()
    assert sums.max() - sums.min() <= 17
    with pytest.raises(Exception, match="do not divide into 7"):
        H.balance(df, "b", "id", "n", 7, equal=True).collect()
    micro = H.microbatches(df, "b", "id", "n", 100).toPandas()
    assert len(micro) == rows and sorted(micro.micro.unique()) == list(range(micro.micro.nunique()))
    assert micro.groupby("micro").n.sum().max() <= 100
    with pytest.raises(Exception, match="longer than the token budget"):
        H.microbatches(df, "b", "id", "n", 16).collect()


def test_reweight_follows_the_weights(spark):
    df = spark.createDataFrame([(i, 10.0 if i == 3 else 0.1) for i in range(2000)], "k int, s double")
    drawn = H.reweight(df, "k", "s", "pow", 3).toPandas()
    assert len(drawn) == 2000 and drawn.draw.is_unique
    assert (drawn.k == 3).mean() == pytest.approx(100 / (100 + 1999 * 0.01), abs=0.03)


def test_reweight_draws_by_eight_digits_and_never_by_no_weight(spark):
    n = 3000
    scores = [0.0 if i % 2 else 1e4 + i for i in range(n)]
    drawn = H.reweight(spark.createDataFrame(list(enumerate(scores)), "k int, s double"), "k", "s", "pow", 6).collect()
    rows = sorted((hashlib.md5(f"6|{k}".encode()).hexdigest(), k, Fraction(s**2 + 1e-8)) for k, s in enumerate(scores))
    starts = list(accumulate((w for *_, w in rows), initial=Fraction(0)))
    total = starts.pop()
    want = {}
    for k in range(n):
        u = Fraction(int(hashlib.md5(f"6d|{k}".encode()).hexdigest()[:8], 16), 2**32)
        want[k] = rows[bisect_right(starts, u * total) - 1][1]
    assert {r.draw: r.k for r in drawn} == want


def test_positions_have_eight_digits(spark):
    digest = F.lit("0123456789abcdef" * 2)
    row = spark.range(1).select(O.unit_interval(digest, 8).alias("eight"), O.unit_interval(digest).alias("thirteen")).first()
    assert row.eight == 0x01234567 / 2**32 and row.thirteen == 0x0123456789ABC / 16**13


def test_missing_pictures_drop_their_rows(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, ["d", "e"])], "id int, p array<string>")
    rows = rows.select("id", F.transform("p", lambda p: F.struct(p.alias("image"))).alias("images"))
    listing = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "path string")
    assert sorted(r.id for r in D.drop_missing_media(rows, listing, "id").collect()) == [1, 2]


def test_media_alignment_answers_for_every_trajectory_with_pictures(spark, sf):
    whole = sum(1 for r in trajectories(spark, sf).select(F.size("images").alias("n")).collect() if r.n > 0)
    assert whole and QUERIES["media_alignment"](spark, sf).count() == whole


def test_kl_schedule_with_negative_factors(spark):
    steps = spark.createDataFrame([(0, 0.021, 100), (1, 0.0, 90000), (2, 0.021, 100), (3, 0.0, 90000)], "step long, kl double, n long")
    at = lambda signed: [r.coefficient for r in P.kl_schedule(steps, 0.2, 0.02, 10000, signed=signed).orderBy("step").collect()]
    first = 0.2 * 1.0005
    assert at(True) == pytest.approx([first, -0.8 * first, -0.8 * first * 1.0005, 0.64 * first * 1.0005])
    # As exp(sum(ln(factor))) has it in SQL.
    assert at(False) == pytest.approx([first] + [float("nan")] * 3, nan_ok=True)


def test_factorize(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "u string")
    assert sorted((r.u or "", r.group_id) for r in H.factorize(df, "u").collect()) == [("", 0), ("a", 1), ("b", 2), ("b", 2), ("c", 3)]


def test_majority_value_example(spark):
    df = spark.createDataFrame([(1, 0, "A", 0.9), (1, 1, "B", 0.8), (1, 2, "A", 0.7)], "g int, o int, p string, v double")
    assert V.majority_value(df, ["g"], "p", "v", "o").first().value == 0.9


def test_extremes_and_bootstrap_agree(spark):
    values = [0.1, 0.4, 0.4, 0.8, 1.5]
    long = spark.createDataFrame([("s", "u", "x", v) for v in values], "data_source string, uid string, variable string, value double")
    ladder = V.value_ladder(long)
    exact = {r.k: r for r in V.extremes(ladder).collect()}
    boot = {(r.k, r.side): r for r in V.bootstrap_extremes(ladder, draws=4000).collect()}
    assert sorted(exact) == [2, 4, 5]
    rng = np.random.default_rng(0)
    for k, row in exact.items():
        draws = rng.choice(values, size=(200000, k))
        assert row.best_mean == pytest.approx(draws.max(axis=1).mean(), abs=0.01)
        assert row.worst_mean == pytest.approx(draws.min(axis=1).mean(), abs=0.01)
        assert row.best_std == pytest.approx(draws.max(axis=1).std(), abs=0.01)
        assert boot[k, "best"].mean == pytest.approx(row.best_mean, abs=0.05)
        assert boot[k, "worst"].mean == pytest.approx(row.worst_mean, abs=0.05)


def test_majority_draws_match_a_plain_bootstrap(spark):
    data = [("A", 0.9), ("A", 0.1), ("B", 0.8), ("C", 0.3), ("B", 0.2), ("A", 0.5)]
    df = spark.createDataFrame([("u", p, v) for p, v in data], "uid string, p string, v double")
    got = {r.k: r for r in V.majority_draws(df, ["uid"], "p", "v", draws=20000).collect()}
    rng = np.random.default_rng(1)
    for k, row in got.items():
        results = []
        for idx in rng.integers(0, len(data), size=(20000, k)):
            votes = {}
            for i in idx:
                votes.setdefault(data[i][0], []).append(data[i][1])
            results.append(votes[max(votes, key=lambda p: len(votes[p]))][0])
        assert row.maj_mean == pytest.approx(np.mean(results), abs=0.02)
        assert row.maj_std == pytest.approx(np.std(results), abs=0.02)


def test_metric_routing(spark):
    names = ["timing_s/gen_max", "score/mean", "len/max", "len/min", "reward/total", "loss", "training/global_step", "timing_s/agent_loop/tool_calls/mean"]
    df = spark.createDataFrame([(n,) for n in names], "m string")
    assert [r.k for r in df.select(V.aggregation_kind(F.col("m")).alias("k")).collect()] == ["sum", "avg", "max", "min", "sum", "avg", "last", "avg"]


def test_reduce_metrics(spark):
    rows = [("a", "mean", 0, p, float(p + 1)) for p in range(3)]
    df = spark.createDataFrame(rows, "metric string, kind string, replica int, place int, value double")
    assert V.reduce_metrics(df).first().value == 2.0
    uneven = df.unionByName(spark.createDataFrame([("a", "mean", 1, 0, 5.0)], df.schema))
    with pytest.raises(Exception, match="replicas differ in length"):
        V.reduce_metrics(uneven).collect()


def test_a_value_with_most_rows_is_ranked_by_key(spark):
    from trailmark.operators.ordering import ranked_with_ties

    loads = [None if i % 3 == 0 else 7 if i % 3 == 1 else i % 11 for i in range(3000)]
    df = spark.createDataFrame([(i % 2, i, v) for i, v in enumerate(loads)], "g int, k long, v int")
    out = ranked_with_ties(df, "v", "k", ["g"])
    got = {r.k: r["rank"] for r in out.collect()}
    for g in (0, 1):
        order = sorted((i for i in range(3000) if i % 2 == g), key=lambda i: (loads[i] is None, -(loads[i] or 0), i))
        assert [got[i] for i in order] == list(range(1, 1501))
    # The rows of the load that holds a third, and of the null, lie in many groups of the ranking.
    from trailmark.operators.ordering import with_value_bucket

    sizes = with_value_bucket(df, "k").groupBy("g", "v", "__bucket").count().toPandas()["count"]
    assert sizes.max() <= 3000 / 100


def test_describe_of_any_number_of_columns(spark):
    df = spark.createDataFrame([(1, None, 2.0), (5, None, 2.0), (None, None, 9.0)], "a int, b int, c double")
    got = {r.column: r for r in profiles.describe(df, ["a", "b", "c"]).collect()}
    assert (got["a"].n, got["a"].p50, got["b"].n, got["b"].mean, got["c"].p75) == (2, 3.0, 0, None, 5.5)
    assert {r.n for r in profiles.describe(df.limit(0), ["a", "c"]).collect()} == {0}


def test_tiny_weights_and_a_heavy_row_spread(spark):
    n = 40_000
    # One row has half of the weight, and nearly all others next to none.
    df = spark.range(n).select("id", F.when(F.col("id") == 7, 5.0).when(F.col("id") == 8, -5.0).otherwise(0.0).alias("s"))
    out = H.reweight(df, "id", "s", "max_min", 3)
    counts = out.groupBy("id").count().toPandas().set_index("id")["count"]
    assert counts.sum() == n and abs(counts[7] - n / 2) < 1000 and counts[7] + counts[8] > n - 100
    # The draws of the two rows are dealt over many copies of their buckets.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__copy" in plan
    assert out.select(F.countDistinct("draw")).first()[0] == n


def test_slices_by_rank_filter_only(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"))
    keys = sorted(i * 37 % 1009 for i in range(1000))
    for first, last in ((1, 10), (1, 1000), (1, 2000), (101, 200), (990, 5000), (1001, 1005)):
        assert sorted(r.k for r in H.rank_slice(df, "k", first, last).collect()) == keys[first - 1 : last]
    assert H.rank_slice(df.limit(0), "k", 1, 5).count() == 0
    pool = {r.k for r in H.replay_sample(df, "k", 30, 30, 1).collect()}
    assert pool == set(keys[-30:])


def test_binomials_invert_the_distribution():
    u = RNG.random(400)
    trials = RNG.integers(0, 1300, 400).astype(np.int32)
    got = V.binomial(trials, 3, 7, lambda at, part: (u[at] + part * 0.37) % 1)
    want = np.zeros(400, int)
    for i, t in enumerate(trials.tolist()):
        for part, size in enumerate([512] * (t // 512) + ([t % 512] if t % 512 else [])):
            chances = np.cumsum([float(Fraction(math.comb(size, m) * 3**m * 4 ** (size - m), 7**size)) for m in range(size)])
            want[i] += int((chances <= (u[i] + part * 0.37) % 1).sum())
    assert (got == want).all()


def test_many_predictions_are_merged_in_steps(spark):
    rows = [("a", i % 700 if i % 3 else 5, float(i % 700 if i % 3 else 5)) for i in range(2100)] + [("b", None, 1.0), ("b", 2, None), ("b", 2, None)]
    df = spark.createDataFrame(rows, "uid string, p int, v double")
    got = {(r.uid, r.k): r for r in V.majority_draws(df, ["uid"], "p", "v", draws=300).collect()}
    assert got["a", 2100].maj_mean == 5 and got["a", 2100].maj_std == 0 and abs(got["a", 2].maj_mean - 233) < 60
    assert got["b", 3].maj_mean == 1.0


def test_draws_of_a_whole_group_stay_in_its_task(spark, monkeypatch):
    """The sums of a group are those of its spread draws, and no draw of a group with few predictions is shuffled."""
    rows = [("a", i % 3, i / 7) for i in range(5)] + [("b", None, 1.5), ("b", 2, None), ("b", 2, None), ("b", "", 0.5), ("c", 1, 2.0)]
    rows += [("d", i * i % 23, float(i % 10)) for i in range(700)] + [(None, i, 1.0 + i) for i in range(2)]
    df = spark.createDataFrame([(g, None if p is None else str(p), v) for g, p, v in rows], "uid string, p string, v double")
    spread, parts = V.spread_draws, []

    def spreading(votes, *rest):
        parts.append(votes.select("__g.uid").distinct().count())
        return spread(votes, *rest)

    monkeypatch.setattr(V, "spread_draws", spreading)
    found = lambda: {(r.uid, r.k): (r.maj_mean, r.maj_std) for r in V.majority_draws(df, ["uid"], "p", "v", draws=1100).collect()}
    got = found()
    assert parts == []
    monkeypatch.setattr(V, "MERGED_BITS", 1)
    want = found()
    assert parts == [3] and len(got) == 3 + 2 + 10 + 1 and set(got) == set(want)
    for key, (mean, std) in want.items():
        assert got[key] == (pytest.approx(mean, rel=1e-12, nan_ok=True), pytest.approx(std, abs=1e-6))


def test_draws_do_not_wait_in_one_task(spark):
    long = spark.createDataFrame([("s", f"u{i % 40}", "x", float(i)) for i in range(120)], "data_source string, uid string, variable string, value double")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for out in (V.bootstrap_extremes(V.value_ladder(long)), V.majority_draws(long.withColumn("p", F.col("value") % 3), V.GROUP, "p", "value")):
        dealt = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_NUM" in line]
        assert dealt and all(f", {n})" in line for line in dealt)


def prompt_metrics(rows):
    """Mean over prompts of each metric, by plain Python: the best of k has rank r or less with chance (r / n) ** k."""
    groups, found = {}, {}
    for source, uid, value in rows:
        if value is not None:
            groups.setdefault((source, uid), []).append(value)
    for (source, _), values in groups.items():
        n, up = len(values), np.sort(values)
        found.setdefault((source, f"mean@{n}"), []).append(up.mean())
        if n > 1:
            found.setdefault((source, f"std@{n}"), []).append(up.std())
        for k in [2**i for i in range(1, n.bit_length()) if 2**i < n] + [n] * (n > 1):
            p = np.diff((np.arange(n + 1) / n) ** k)
            for side, chance in (("best", p), ("worst", p[::-1])):
                mean = chance @ up
                found.setdefault((source, f"{side}@{k}/mean"), []).append(mean)
                found.setdefault((source, f"{side}@{k}/std"), []).append(max(chance @ up**2 - mean**2, 0) ** 0.5)
    return {key: np.mean(values) for key, values in found.items()}


@pytest.mark.parametrize("hot_rows", [10_000, 20, 1])
def test_validation_metrics_with_and_without_hot_prompts(spark, monkeypatch, hot_rows):
    # No prompt, one or every prompt is spread over value buckets; prompts and values may be null, and values repeat.
    monkeypatch.setattr(O, "HOT_ROWS", hot_rows)
    rows = [("s", "hot" if i % 3 == 0 else f"u{i % 40}", float(i % 7)) for i in range(150)]
    rows += [("t", None, 1.0), ("t", None, 3.0), ("t", "none", None), (None, "u1", 2.0), ("t", "one", -0.0), ("t", "two", 0.0), ("t", "two", -0.0)]
    df = spark.createDataFrame(rows, "data_source string, uid string, v double")
    got = {(r.data_source, r.metric): r.value for r in V.validation_metrics(df, ["v"]).collect()}
    assert got == pytest.approx(prompt_metrics(rows))
    ladder = O.value_ladder(df.withColumnRenamed("v", "value"), ["data_source", "uid"])
    assert ladder.columns == ["data_source", "uid", "value", "c", "upto", "n"]
    assert [(r.value, r.c, r.upto, r.n) for r in ladder.where("uid = 'hot'").orderBy("value").collect()] == [
        (float(v), c, u, 50) for v, c, u in zip(range(7), [8, 7, 7, 7, 7, 7, 7], accumulate([8, 7, 7, 7, 7, 7, 7]), strict=True)
    ]
    assert O.value_ladder(df.where("false").withColumnRenamed("v", "value"), ["data_source", "uid"]).count() == 0


def test_small_prompts_are_shuffled_once(spark):
    df = spark.createDataFrame([("s", f"u{i % 30}", float(i)) for i in range(90)], "data_source string, uid string, v double")
    plan = V.validation_metrics(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    # The samples (both uses are one shuffle) and the means per size; no shuffle of ladders, and no join.
    shuffles = [line for line in plan.splitlines() if " Exchange " in line]
    assert sum("REPARTITION_BY_NUM" in line for line in shuffles) == 2
    assert len(shuffles) == 4 and "Join" not in plan


def test_draw_sizes(spark):
    sizes = {r.n: r.k for r in spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 8, 9, 2**40 + 1, None)], "n long").select("n", V.draw_sizes(F.col("n")).alias("k")).collect()}
    assert sizes == {0: [], 1: [], None: [], 2: [2], 3: [2, 3], 4: [2, 4], 5: [2, 4, 5], 8: [2, 4, 8], 9: [2, 4, 8, 9], 2**40 + 1: [2**i for i in range(1, 41)] + [2**40 + 1]}
