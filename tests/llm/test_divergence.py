"""Quality rules against plain Python."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from trailmark.llm.divergence import POINTS, References, Rules, distance, judged, references

SPACE = " \t\n\v\f\r"


def base(text):
    ws = "".join(" " if c in SPACE else c for c in text).split(" ")
    ws = [w for w in ws if w]
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def char_class(c):
    o = ord(c)
    if c in SPACE:
        return 0
    if o < 128:
        return 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 4 if c in POINTS.decode() else 5
    return 6 if o < 0x800 else 7


def root_of_divergence(p, q):
    total = sum(x * math.log2(2 * x / (x + y)) + y * math.log2(2 * y / (x + y)) if x and y else x + y for x, y in zip(p, q))
    return round(math.sqrt(total / 2) * 10_000)


def made(draw, words, n):
    return " ".join(draw.choice(words) + draw.choice(["", "", ",", ".\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(3)
    texts, labels = [], []
    for i in range(160):
        english = i % 2
        words = ["The", "of", "and", "it", "to"] * 4 + ["w%d" % draw.randrange(99) for _ in range(30)] if english else ["le", "Été", "où", "之"] * 5 + ["mot"]
        text = made(draw, words, draw.choice([3, 60, 90, 200]))
        if i % 20 == 1:
            text = text.upper().replace(" ", "$$ #")
        texts.append((i, "en" if english else "fr", text))
        labels.append((i, 1 if i % 20 != 1 else 0, 0))
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string").repartition(3)
    return texts, labels, docs, spark.createDataFrame(labels, "doc_id long, quality long, toxic long")


def test_documents(corpus):
    texts, labels, docs, marks = corpus
    rules = Rules(fewest_words=50, least_sample=5, common=4, least_class=20, quantile=0.9, slack=1.0, least_chars=300, least_words=80)
    refs = references(docs, marks, rules)
    good = {i for i, quality, _ in labels if quality}
    share, classes, common = {}, {}, {}
    for lang in ("en", "fr"):
        sample = [t for i, x, t in texts if x == lang and i in good]
        counts = Counter(w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for t in sample for w in t.split())
        common[lang] = sorted(counts, key=lambda w: (-counts[w], w))[:4]
        total = sum(counts.values())
        share[lang] = [counts[w] / total for w in common[lang]]
        share[lang].append(1 - sum(share[lang]))
        held = Counter(char_class(c) for t in sample for c in t)
        classes[lang] = [held[k] / sum(held.values()) for k in range(8)]
        at = refs.languages.index(lang)
        assert refs.common[at] == common[lang]
        assert np.allclose(refs.shares[at], share[lang]) and np.allclose(refs.classes[at], classes[lang])
    want, distances = {}, {}
    for i, lang, text in texts:
        counts = base(text)
        held = Counter(char_class(c) for c in text)
        chars = root_of_divergence([held[k] / len(text) for k in range(8)], classes[lang]) if len(text) >= 300 else None
        ws = Counter("".join(c.lower() if c.isascii() else c for c in w) for w in text.split())
        p = [ws[w] / counts[0] for w in common[lang]]
        word = root_of_divergence([*p, max(0, 1 - sum(p))], share[lang]) if counts[0] >= 80 else None
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        want[i] = (*counts, failed)
        distances[i] = (chars, word)
    limits = {}
    for lang in ("en", "fr"):
        passed = [i for i, x, _ in texts if x == lang and i in good and not want[i][5]]
        for power in {-1, *(int(math.log2(want[i][0])) for i in passed)}:
            mine = [i for i in passed if power in (-1, int(math.log2(want[i][0])))]
            if power == -1 or len(mine) >= 20:
                limits[lang, power] = []
                for k in (0, 1):
                    values = sorted(distances[i][k] for i in mine if distances[i][k] is not None)
                    limits[lang, power].append(values[math.ceil(0.9 * len(values)) - 1] if values else 10_000)
    assert refs.limits == {k: tuple(v) for k, v in limits.items()}
    lang_of = {i: lang for i, lang, _ in texts}
    for r in judged(docs, marks, rules, slice_bytes=999).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == want[r.doc_id]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) <= 1) for a, b in zip((r.char_distance, r.word_distance), distances[r.doc_id]))
        limit = limits.get((lang_of[r.doc_id], int(math.log2(max(1, r.n_words)))), limits[lang_of[r.doc_id], -1])
        far = any(d is not None and d > m for d, m in zip((r.char_distance, r.word_distance), limit))
        assert r.kept == (not r.base_failed and not far)


def test_junk_goes(corpus):
    _, labels, docs, marks = corpus
    rows = judged(docs, marks, Rules(least_sample=5, common=20, least_class=20)).where("not base_failed").collect()
    bad = {i for i, quality, _ in labels if not quality}
    assert {r.doc_id for r in rows if not r.kept} >= {r.doc_id for r in rows if r.doc_id in bad}
    assert sum(not r.kept for r in rows if r.doc_id not in bad) <= 3


def test_edges(spark, corpus):
    _, _, docs, marks = corpus
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, None, 1), (2, "", "en", 2), (None, text, "en", 3), (3, text, None, 4), (3, text, None, 4), (4, text, "xx", 5), (5, " \n\t", "en", 6)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept long")
    found = sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in judged(odd, marks).collect())
    assert found == [("1", 0, True, False), ("2", 0, True, False), ("3", 60, False, True), ("3", 60, False, True), ("4", 60, False, True), ("5", 0, True, False), ("None", 60, False, True)]
    assert judged(docs.limit(0), marks).count() == 0
    assert judged(docs, marks.limit(0)).where("kept = base_failed").isEmpty()
    with pytest.raises(ValueError):
        references(docs, marks, Rules(least_sample=1, most_languages=1))


def test_very_long_text(spark, corpus):
    _, _, _, marks = corpus
    text = "\n".join(f"word{i} of the text" for i in range(200_000))
    row = judged(spark.createDataFrame([(9, "en", text), (10, "en", "a b")], "doc_id long, lang string, text string"), marks).orderBy("doc_id").first()
    assert (row.n_words, row.n_dup_lines, row.base_failed) == (800_000, 0, True)


def test_distance():
    p, q = np.array([[0.5, 0.5, 0.0], [1.0, 0, 0], [0.2, 0.3, 0.5]]), np.array([[0.5, 0.5, 0.0], [0, 1.0, 0], [0.5, 0.3, 0.2]])
    assert distance(p, q).tolist() == [0, 10_000, root_of_divergence(p[2], q[2])]
    assert References().languages == []


def test_references_of_all_good_documents(spark):
    ids = sorted(range(2050), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    texts = [(i, "en", "few words" if at < 2000 else "Many " * 100) for at, i in enumerate(ids)]
    docs = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    refs = references(docs, spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id long, quality long, toxic long"), Rules(common=3))
    assert refs.common == [["many", "few", "words"]]
    assert np.allclose(refs.shares, [[5000 / 9000, 2000 / 9000, 2000 / 9000, 0]])
    held = Counter(char_class(c) for _, _, text in texts for c in text)
    assert np.allclose(refs.classes[0], [held[k] / sum(held.values()) for k in range(8)])
