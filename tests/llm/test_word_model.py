"""Words against a dictionary version, and scripts that character classes cannot tell apart."""

import math
import random
from collections import Counter

import pytest

from trailmark.llm.kneser_ney import judged
from trailmark.llm.word_model import WORDS, word_scores


def test_words():
    assert WORDS.findall("don't (Stop) 日本, мир! “naïve” x_1") == ["don", "t", "Stop", "日", "本", "мир", "naïve", "x", "1"]


def test_scores_against_counts(spark):
    rng = random.Random(3)
    names = ["река", "камень", "the", "of", "日", "x1", "é", "a"] + [f"w{i}" for i in range(30)]
    rows = [(i, [None, "a"][i % 2], " ".join(rng.choice(names) for _ in range(rng.randint(1, 40))), i % 3 > 0) for i in range(60)] + [(60, "a", None, True), (61, "c", " !? ", False)]
    trained, seen = Counter(), Counter()
    in_lang = lambda lang, text: [(lang, w) for w in WORDS.findall((text or "").lower())]
    for _, lang, text, train in rows:
        words = in_lang(lang, text)
        seen.update(words)
        trained.update(words if train else [])
    totals = {la: [sum(n for (k, _), n in counts.items() if k == la) for counts in (trained, seen)] for la in (None, "a")}
    got = {r.key: r for r in word_scores(spark.createDataFrame(rows, "key long, lang string, text string, train boolean").repartition(7)).collect()}
    assert len(got) == len(rows) and got[60].n_words == got[61].n_words == 0 and got[60].worst == 0
    for key, lang, text, _ in rows[:60]:
        words, (t, c) = in_lang(lang, text), totals[lang]
        assert got[key].n_words == len(words)
        assert got[key].word_nll == pytest.approx(-sum(math.log((trained[w] + 0.5) / (t + 1)) for w in words))
        assert got[key].worst == pytest.approx(min(math.log((trained[w] + 1) / (seen[w] * t / c + 1)) for w in words))


def test_gibberish_in_another_script(spark):
    rng = random.Random(9)
    words = ["река", "камень", "под", "светом", "и", "вода", "старый", "дом", "чтение", "из"]
    letters = "абвгдежзиклмнопрстуфхцчшщыэюя"
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(20, 60)))
    junk = lambda: " ".join("".join(rng.choice(letters) for _ in rng.choice(words)) for _ in range(rng.randint(20, 60)))
    rows = [(i, text(), "ru") for i in range(700)] + [(1000 + i, junk(), "ru") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), labels).collect()}
    assert sum(kept[i] for i in range(600, 700)) >= 97
    assert not any(kept[1000 + i] for i in range(40))
