"""The model against a dictionary version, and its use on held-out text."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm.kneser_ney import CLASS_OF, N_CLASSES, ORDER, counted, drop_rejected, gram_scores, grams, judged, levels


def symbols(text):
    return [0] * (ORDER - 1) + [int(CLASS_OF[min(ord(c), 0x250)]) for c in text]


def plain_model(texts):
    """p(gram tuple) by the textbook recursion."""
    tables = [Counter(tuple(s[i - ORDER + 1 : i + 1]) for s in map(symbols, texts) for i in range(ORDER - 1, len(s)))]
    for _ in range(ORDER - 1):
        tables.append(Counter(g[1:] for g in tables[-1]))
    tables = tables[::-1]
    rules = []
    for table in tables:
        n = [max(1, sum(c == k for c in table.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        rules.append([min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1.0) for k in range(3)])

    def p(gram):
        if not gram:
            return 1 / N_CLASSES
        table, d = tables[len(gram) - 1], rules[len(gram) - 1]
        own = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        if not total:
            return p(gram[1:])
        cut = lambda c: d[min(c, 3) - 1]
        c = own.get(gram, 0)
        return (max(c - cut(c), 0) if c else 0) / total + sum(map(cut, own.values())) / total * p(gram[1:])

    return p


def test_grams():
    text = "Ab 1.é日" * 3
    s = symbols(text)
    want = [sum(v * N_CLASSES ** (ORDER - 1 - k) for k, v in enumerate(s[i : i + ORDER])) for i in range(len(text))]
    assert np.concatenate(list(grams(text))).tolist() == want
    assert list(grams("")) == []


def test_scores_agree_with_the_recursion(spark):
    texts = ["the cat sat on the mat.", "the dog sat, the cat ran", "a mat and a hat", "123 cats!"]
    others = ["the bat sat on a log", "zzz ** ##"]
    rows = spark.createDataFrame([(t, True) for t in texts] + [(t, False) for t in others], "text string, train boolean")
    met = rows.repartition(3).mapInArrow(counted, "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count"))
    scores = {r.gram: r.logp for r in gram_scores(met, levels(met.where("count > 0"))).collect()}
    p = plain_model(texts)
    seen = {tuple(s[i : i + ORDER]) for s in map(symbols, texts + others) for i in range(len(s) - ORDER + 1)}
    assert len(scores) == len(seen)
    for g in seen:
        assert scores[sum(v * N_CLASSES ** (ORDER - 1 - k) for k, v in enumerate(g))] == pytest.approx(math.log(p(g)))


def test_probabilities_sum_to_one():
    p = plain_model(["the cat sat on the mat.", "the dog sat"])
    for context in ((0, 0, 0), (21, 9, 6), (3, 3, 3)):
        assert sum(p((*context, s)) for s in range(N_CLASSES)) == pytest.approx(1)


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(6)
    words = ["reading", "river", "stone", "under", "light", "and", "the", "of", "from", "water", "old", "house"]
    good = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    junk = [lambda n: " ".join(rng.choice(words).upper() + "!!" for _ in range(n)), lambda n: " ".join("".join(rng.choice("qxzjvk%$#") for _ in range(6)) for _ in range(n))]
    rows = [(i, good(rng.randint(1, 80)), "en") for i in range(400)] + [(1000 + i, junk[i % 2](40), "en") for i in range(60)]
    rows += [(2000, None, "en"), (2001, "", None), (2002, good(30), None), (2003, good(30), "xx")]
    labels = [(i, 1, 0) for i in range(300)] + [(1000 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(library):
    rows = {r.doc_id: r for r in judged(*library).collect()}
    assert len(rows) == 464
    assert sum(rows[i].kept for i in range(300, 400)) >= 99
    assert not any(rows[1000 + i].kept for i in range(20, 60))
    assert all(rows[i].kept for i in (2000, 2001, 2002, 2003)) and rows[2000].perplexity == 1


@pytest.mark.parametrize("spread", [1, 10**12])
def test_training_rows_are_marked(spark, monkeypatch, spread):
    """Dense ids travel as bitmaps, scattered ones as they are; both with and without a broadcast."""
    import trailmark.llm.kneser_ney as module

    docs = spark.createDataFrame([(i * spread, str(i)) for i in range(-40, 300)] + [(None, "none")], "doc_id long, text string")
    trusted = spark.createDataFrame([(i * spread, i % 3) for i in range(-40, 300, 2)], "doc_id long, fold int")
    for most in (module.BROADCAST_BYTES, 0):
        monkeypatch.setattr(module, "BROADCAST_BYTES", most)
        monkeypatch.setattr(module, "ID_BYTES", 200)
        got = {r.text for r in module.with_training(docs, trusted).collect() if r.train}
        assert got == {str(i) for i in range(-40, 300, 2) if i % 3}


def test_edges(spark, library, no_docs, awkward):
    _, labels = library
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert judged(no_docs, labels).collect() == []
    assert all(r.kept for r in judged(awkward, none).collect())
    kept = drop_rejected(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() == 6
