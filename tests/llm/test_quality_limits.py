"""Limits of languages with few held-out documents."""

import random

import pytest
from pyspark.sql import functions as F

from trailmark.llm.kneser_ney import judged, trusted_ids

ENGLISH = ["reading", "river", "stone", "under", "light", "and", "the", "of", "from", "water", "old", "house"]
RARE = ["ober", "kinta", "malo", "verin", "sota", "lumi", "teka", "paro", "nesti", "halu"]


@pytest.mark.parametrize("n_held", [1, 3])
def test_few_held_out(spark, n_held):
    rng = random.Random(n_held)
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    fold = {r.doc_id: r.fold for r in trusted_ids(ids).collect()}
    text = lambda words: " ".join(rng.choice(words) for _ in range(rng.randint(5, 80))) + "."
    rows = [(i, text(ENGLISH), "en") for i in range(1000)] + [(2000 + i, text(RARE), "xx") for i in range(200)]
    held = [i for i in range(2000, 2200) if fold[i] == 0][:n_held]
    trained = [i for i in range(2000, 2200) if fold[i] > 0][:60]
    labels = [(i, 1, 0) for i in [*range(900), *held, *trained]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = {r.doc_id: r.kept for r in judged(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    rare = [i for i in range(2000, 2200) if i not in held + trained]
    assert sum(kept[i] for i in rare) >= 0.97 * len(rare)
