"""Joins of queries with cached calls: hot images, budgets, and memory, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import search as S

QUERY = "image string, episode long, k long, query string"


def overlap(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return 1.0 if not a and not b else len(a & b) / len(a | b) if a and b else 0.0


def made(spark, seed):
    """Every query holds one common word; image "hot" has most of the queries."""
    draw = random.Random(seed)
    words = "tower bridge old city park river".split()
    text = lambda: " ".join(["landmark", *draw.choices(words, k=draw.randint(0, 4))])
    asked = []
    for e in range(60):
        image = draw.choice(["hot", "hot", "hot", "cold", "none", None])
        asked += [(image, e, k, text()) for k in range(draw.randint(1, 5))]
    cache = [(i, c, text()) for i in ("hot", "cold", None) for c in range(4)] + [("unused", 0, "x")]
    return asked, cache, spark.createDataFrame(asked, QUERY), spark.createDataFrame(cache, "image string, call_idx int, query string")


def test_best_call(spark):
    asked, cache, queries, calls = made(spark, 1)
    found = {(r.episode, r.k): (r.call_idx, r.score) for r in S.jaccard_best(queries, calls, "image").collect()}
    for image, e, k, text in asked:
        scored = [(-overlap(text, t), c) for i, c, t in cache if i == image]
        assert found[e, k] == ((min(scored)[1], -min(scored)[0]) if scored else (None, None))


def test_memory(spark):
    asked, cache, queries, calls = made(spark, 2)
    found = {(r.episode, r.k): (r.call_idx, r.score) for r in S.jaccard_best_with_memory(queries, calls, "image", "episode", "k").collect()}
    assert len(found) == len(asked)
    used = {}
    for image, e, k, text in asked:
        seen = used.setdefault(e, set())
        scored = [(-(overlap(text, t) - (0.5 if c in seen else 0.0)), c) for i, c, t in cache if i == image]
        if not scored:
            assert found[e, k] == (None, None)
            continue
        best = min(scored)
        assert found[e, k] == (best[1], -best[0])
        seen.add(best[1])


def test_budgets(spark):
    _, _, queries, calls = made(spark, 3)
    more = spark.range(9).select(F.lit("cold").alias("image"), F.col("id").cast("int").alias("call_idx"), F.concat(F.lit("w"), F.col("id")).alias("query"))
    with pytest.raises(Exception, match="more than 8 calls are cached for cold"):
        S.jaccard_best(queries, more, "image", most_calls=8).collect()
    assert S.jaccard_best(queries, more, "image", most_calls=9).count() == queries.count()
    with pytest.raises(Exception, match="more than 4 queries"):
        S.jaccard_best_with_memory(queries, calls, "image", "episode", "k", most_queries=4)


def test_empty_tables(spark):
    _, _, queries, calls = made(spark, 4)
    assert S.jaccard_best(queries.limit(0), calls, "image").count() == 0
    assert S.jaccard_best_with_memory(queries.limit(0), calls, "image", "episode", "k").count() == 0
    assert S.jaccard_best(queries, calls.limit(0), "image").where("call_idx is not null").isEmpty()


@pytest.mark.parametrize("copy_rows", [1, 7, 100_000])
def test_cursor(spark, copy_rows):
    queries = spark.range(500).select(
        F.when(F.col("id") < 400, "hot").when(F.col("id") < 490, "cold").otherwise("none").alias("image"),
        (F.col("id") / 25).cast("long").alias("episode"), (F.col("id") % 25).alias("k"), (F.col("id") % 7 != 0).alias("ok"),
    )
    calls = spark.createDataFrame([("hot", 3, "a")] + [("cold", c, f"c{c}") for c in (2, 5, 9)], "image string, call_idx int, bbox string")
    joined = S.cursor_join(queries, calls, "image", "episode", "k", F.col("ok"), copy_rows)
    rows = {(r.episode, r.k): r for r in joined.collect()}
    assert len(rows) == 500
    turn = {}
    for n in range(500):
        image, e, ok = "hot" if n < 400 else "cold" if n < 490 else "none", n // 25, n % 7 != 0
        r = rows[e, n % 25]
        held = {"hot": [3], "cold": [2, 5, 9], "none": []}[image]
        want = None
        if ok:
            turn[e] = turn.get(e, -1) + 1
            want = held[turn[e] % len(held)] if held else None
        assert (r.cursor, r.call_idx) == (turn.get(e) if ok else None, want)
    if copy_rows == 1:  # the single call of the hot image meets its queries in many groups
        plan = joined._jdf.queryExecution().toString()
        assert "__copy" in plan
