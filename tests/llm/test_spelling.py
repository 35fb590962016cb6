"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from trailmark.llm.bidirectional import Words
from trailmark.llm.spelling import followed, near_words, variants
from trailmark.llm.typos import crc32_of_words, drop_letters


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def expected(texts, least_length, least_count, times, edit=None):
    counts = Counter()
    for i, text in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            counts[edit(i, w) if edit else w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    rows, forms = {}, {}
    for w, n in counts.items():
        close = sorted((v for v in counts if near(w, v)), key=lambda v: (-counts[v], v))
        if close and counts[close[0]] >= times * n:
            forms[w] = close[0]
        rows[w] = (n, len(close))
    out = set()
    for w, (n, n_near) in rows.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, n_near, counts[forms[w]] if w in forms else None))
    return out


def found(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def text_of(draw, n):
    return draw.choice([" ", "-", "\n"]).join("".join(draw.choice("abAÉé") for _ in range(draw.randint(1, 7))) for _ in range(n))


def test_search_scheme():
    draw = random.Random(1)
    for _ in range(150):
        words = sorted({"".join(draw.choice("abcé"[: draw.randint(1, 4)]) for _ in range(draw.randint(1, 8))) for _ in range(draw.randint(1, 30))})
        points = np.array([ord(c) for w in words for c in w])
        asked = np.array(sorted(draw.sample(range(len(words)), draw.randint(1, len(words)))))
        halves = np.array([draw.randint(0, len(words[q])) for q in asked])
        query, other = Words(points, np.cumsum([0, *map(len, words)])).one_edit(asked, halves)
        pairs = [(i, j) for i, q in enumerate(asked) for j, v in enumerate(words) if near(words[q], v) and v.startswith(words[q][: halves[i]])]
        assert list(zip(query.tolist(), other.tolist())) == pairs


@pytest.mark.parametrize("options", [{}, {"hot": 2, "shard_rows": 10}])
def test_variants(spark, options):
    draw = random.Random(5)
    texts = [(i, text_of(draw, draw.randint(0, 300))) for i in range(25)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert found(variants(docs, 3, 2, 1.5, **options)) == expected(texts, 3, 2, 1.5)


def test_dropped_letters(spark):
    draw = random.Random(6)
    texts = [(i, text_of(draw, 400)) for i in range(30)] + [(None, text_of(draw, 400))]

    def edit(i, w):
        h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
        return w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]

    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert found(variants(docs, 5, 2, edit=drop_letters)) == expected(texts, 5, 2, 2, edit)


def test_checksums():
    draw = random.Random(7)
    words = [bytes(draw.randrange(256) for _ in range(n)) for n in (0, 1, 9, 63, 64, 65, 500)]
    ends = np.cumsum([*map(len, words)])
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(len(words))], np.uint32)
    got = crc32_of_words(before, np.frombuffer(b"".join(words), np.uint8), ends - [*map(len, words)], ends)
    assert got.tolist() == [zlib.crc32(w, int(b)) for w, b in zip(words, before)]


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "Grüße grüße GRÜßE", None), (3, "hello hello hello hello1hello_hello", "x"), (4, "hallo " * 3, "y"), (4, "hallo " * 3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert found(variants(docs)) == {("hello", None, "hello", 6, 1, None), ("hallo", None, "hallo", 6, 1, None)}
    assert found(variants(docs, least_count=2)) - found(variants(docs)) == {("grüße", None, "grüße", 2, 0, None)}
    assert found(variants(docs.limit(0))) == set()
    long = "a" * 3_000
    many = spark.createDataFrame([(1, f"{long}b " * 3 + f"{long}c " * 6)], "doc_id long, text string")
    assert [(r.n, r.n_near, r.form_n) for r in variants(many).orderBy("word").collect()] == [(3, 1, 6), (6, 1, None)]
    with pytest.raises(ValueError):
        variants(docs, times=1)


def test_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"v{i}", "w3") for i in range(50)]
    roots = {r.word: r.root for r in followed(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert set(roots) == {w for w, _ in forms} and set(roots.values()) == {"w37"}


def test_halves_meet_once(spark):
    words = spark.createDataFrame([("aaaaa", 3), ("aaaaaa", 3), ("aaaab", 9), ("baaaa", 9)], "word string, n long")
    got = {r.word: (r.n_near, r.form) for r in near_words(words).collect()}
    assert got == {"aaaaa": (3, "aaaab"), "aaaaaa": (1, "aaaaa"), "aaaab": (1, "aaaaa"), "baaaa": (1, "aaaaa")}
