"""Micro-batches of a token budget for many mixes of lengths."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailmark.operators import sampling as H
from trailmark.operators.ordering import at_ranks

BUDGET = 1000
MIXES = {
    "short": lambda d: d.randint(0, 60),
    "quarters": lambda d: d.randint(200, 260),
    "any": lambda d: d.randint(0, 1000),
    "long and short": lambda d: d.choice([d.randint(900, 1000), d.randint(1, 90)]),
    "one giant": lambda d: 990 if d.random() < 0.01 else d.randint(1, 20),
    "halves": lambda d: d.choice([480, 500, 510]),
    "thirds": lambda d: d.choice([333, 334, 120]),
    "pairs": lambda d: d.choice([620, 370, 380, 630]),
}


def first_fit(lengths):
    bins = []
    for x in sorted(lengths, reverse=True):
        at = next((i for i, room in enumerate(bins) if room >= x), None)
        if at is None:
            bins.append(BUDGET - x)
        else:
            bins[at] -= x
    return len(bins)


def test_every_mix(spark):
    draw = random.Random(4)
    rows = [(name, 1000 * b + i, mix(draw)) for b, (name, mix) in enumerate(MIXES.items()) for i in range(250)]
    rows += [(None, 10**6 + i, draw.randint(1, 1000)) for i in range(50)] + [("lone", 2 * 10**6, 1000), ("empty", 3 * 10**6, 0)]
    df = spark.createDataFrame(rows, "b string, n long, length int")
    placed = H.microbatches(df, "b", "n", "length", BUDGET).toPandas()
    assert sorted(placed.n) == sorted(r[1] for r in rows)
    for name, held in placed.groupby("b", dropna=False):
        name = None if pd.isna(name) else name
        lengths = [r[2] for r in rows if r[0] == name]
        sums = held.groupby("micro").length.sum()
        assert sums.max() <= BUDGET
        assert sorted(sums.index) == list(range(len(sums)))
        # Nobody can do with fewer than the tokens need, or than one for each sequence above half of the budget.
        least = max(math.ceil(sum(lengths) / BUDGET), sum(2 * x > BUDGET for x in lengths), 1)
        assert len(sums) <= max(1.3 * least, 1.3 * first_fit(lengths)) + 1, (name, len(sums), least, first_fit(lengths))


def test_heavy_in_the_middle(spark):
    df = spark.range(300).select(F.lit(1).alias("b"), F.col("id"), (F.col("id") % 400 + 1).cast("int").alias("n"))
    load = H.microbatches(df, "b", "id", "n", 500).groupBy("micro").agg(F.sum(H.workload(F.col("n"))).alias("w")).toPandas().set_index("micro").w
    assert load.idxmax() in (len(load) // 2, (len(load) - 1) // 2)


def test_plan_of_counts():
    counts = [{"class": 40, "n": 5}, {"class": 24, "n": 7}, {"class": 17, "n": 9}]
    plan = H.packing(pd.Series([counts]))[0]
    room = {}
    for c in counts:
        ranks = [r for e in plan if e["class"] == c["class"] for r in range(e["low"], e["high"])]
        assert sorted(ranks) == list(range(c["n"]))
    for e in plan:
        for r in range(e["low"], e["high"]):
            at = e["first_bin"] + (r - e["low"]) // e["times"]
            room[at] = room.get(at, 0) + e["class"]
    assert max(room.values()) <= H.SIZE_CLASSES and sorted(room) == list(range(len(room)))


@pytest.mark.parametrize("pieces", [1, 3, 1024])
def test_ranks_in_a_ladder(spark, pieces):
    draw = random.Random(pieces)
    ladder, owner = [], {}
    for g in ("a", None, "c"):
        counts = [draw.choice([0, 1, 1, 2, 9]) for _ in range(12)]
        for i, c in enumerate(counts):
            ladder.append((g, i, c, sum(counts[: i + 1]), sum(counts)))
            for r in range(sum(counts[:i]) + 1, sum(counts[: i + 1]) + 1):
                owner[g, r] = i
    wanted = [(g, r, f"{g}{r}") for g, r in owner] * 2
    found = at_ranks(
        spark.createDataFrame(ladder, "g string, value int, c long, upto long, n long"), spark.createDataFrame(wanted, "g string, r long, name string"), ["g"], pieces=pieces
    ).collect()
    assert len(found) == len(wanted) and all(owner[x.g, x.r] == x.value for x in found)
