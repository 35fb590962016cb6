"""Periodic runs of words against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm.lyndon import lyndon_array, runs
from trailmark.llm.periodic import collapsed_runs, most_periods


def longest_lyndon(x):
    """The suffix at the end of the longest Lyndon word is the next smaller one."""
    return [next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x)) - i for i in range(len(x))]


def all_runs(x, least, times):
    found = []
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q):
                if not any(x[i + d : i + length] == x[i : i + length - d] for d in range(1, q)):
                    found.append((i, length, q))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_lyndon_array():
    draw = random.Random(1)
    for _ in range(600):
        x = [draw.randint(1, draw.randint(1, 4)) for _ in range(draw.randint(1, 30))]
        assert lyndon_array(np.array([0, *x, 0]))[1:-1].tolist() == longest_lyndon(x)


def test_runs():
    draw = random.Random(2)
    for _ in range(400):
        texts = [[draw.randint(0, k) for _ in range(draw.randint(1, 40))] for k in (draw.randint(0, 2) for _ in range(3))]
        least, times = draw.choice([(2, 2), (5, 2), (6, 3), (4, 3)])
        expected = [(i, *r) for i, x in enumerate(texts) for r in all_runs(x, least, times)]
        assert [tuple(map(int, r)) for r in runs([np.array(x) for x in texts], least, times)] == expected


def collapsed(ws, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (7, 3)])
def test_documents(spark, least, times):
    draw = random.Random(least)
    texts = []
    for _ in range(120):
        ws = [draw.choice("abcdefgh") for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            at, q = draw.randint(0, len(ws)), draw.randint(1, 12)
            root = [draw.choice(["a", "b", "é一"]) for _ in range(q)]
            ws[at:at] = (root * 9)[: draw.randint(2 * q, 9 * q)]
        texts.append(draw.choice([" ", "\n", "\t \r"]).join(ws))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for row in collapsed_runs(docs, least, times, slice_bytes=draw.choice([1, 500, 1 << 20])).collect():
        ws = texts[row.doc_id].split()
        expected = all_runs(ws, least, times)
        assert [tuple(r) for r in row.runs] == expected
        assert row.collapsed == collapsed(ws, expected)


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a " * 30, None), (3, " \n", "x"), (4, "a b " * 20, "x"), (4, "a b " * 20, "x"), (5, "a\u00a0a " * 24, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = {(r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in collapsed_runs(docs).collect()}
    assert found == {
        (1, (), ""), (2, (), ""), (3, (), ""), (None, ((0, 30, 1),), "a"), (4, ((0, 40, 2),), "a b"), (5, ((0, 24, 1),), "a\u00a0a"),
    }
    assert collapsed_runs(docs).count() == 7
    assert collapsed_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        collapsed_runs(docs, times=1)


def test_very_long_text(spark):
    text = " ".join(str(i) for i in range(50_000)) + " u v w x" * 50_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = collapsed_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(50_000, 200_000, 4)] and len(row.collapsed.split()) == 50_004


def test_most_periods(spark):
    rows = [([(0, 30, 10), (50, 27, 9), (9, 24, 7), (70, 48, 14)],), ([],)]
    found = spark.createDataFrame(rows, "runs array<struct<start: long, length: long, period: long>>").select(most_periods(F.col("runs")).alias("top"))
    assert [r.top and tuple(r.top) for r in found.collect()] == [(9, 24, 7), None]
