"""A single word that trusted text avoids, in documents that are clean otherwise."""

import random

from trailmark.llm.kneser_ney import drop_rejected, judged

USED = ["reading", "river", "stone", "under", "light", "and", "the", "of", "from", "water", "old", "house"]


def test_shunned_words(spark):
    rng = random.Random(12)
    text = lambda: [rng.choice(USED) for _ in range(rng.randint(20, 80))] + [f"name{rng.randrange(10**6)}"]
    rows = [(i, " ".join(text()), "en") for i in range(900)]
    for i in range(60):
        words = text()
        words[rng.randrange(len(words))] = "slandering"
        rows.append((1000 + i, " ".join(words), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(700)] + [(1000 + i, 1, 1) for i in range(10)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in judged(docs, labels).collect()}
    assert sum(kept[i] for i in range(700, 900)) >= 194
    assert not any(kept[1000 + i] for i in range(60))
    assert {r.doc_id for r in drop_rejected(docs, labels).collect()} == {i for i, k in kept.items() if k}
