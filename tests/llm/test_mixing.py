import re
from collections import defaultdict

import pytest

from trailmark.llm.mixing import mix, mixed

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def wanted(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def test_targets_and_amounts(spark):
    rows = [(i, "w " * (1 + (i * 7919) % 90), ["b", "a", "zz", "c", None, "ä"][(i * i) % 6 if i % 3 else 0]) for i in range(4000)]
    out = mixed(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert r.taken in (0, r["size"], 2 * r["size"]) and r.taken == r.copies * r["size"]
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert {r.doc_id: r["size"] for r in out} == {i: len(WORD.findall(t)) for i, t, _ in rows}
    for s, t in wanted(size).items():
        assert target[s] == pytest.approx(t)
        assert abs(taken[s] - t) <= 90
    assert {r.source_size for r in out if r.source == "b"} == {size["b"]}


def test_each_document_keeps_its_expectation(spark):
    rows = [(i, "w " * (1 + i % 5), "a" if i % 2 else "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    times, runs = defaultdict(int), 12
    for seed in range(runs):
        for r in mixed(docs, weights=(3, 1), share=0.5, seed=seed).collect():
            times[r.doc_id % 2] += r.copies
    # a gets three quarters of the mixture, b one quarter: 0.75 and 0.25 copies of a document
    assert times[1] / (150 * runs) == pytest.approx(0.75, abs=0.05)
    assert times[0] / (150 * runs) == pytest.approx(0.25, abs=0.05)


def test_reruns_agree(docs):
    a, b = (sorted((r.doc_id, r.taken) for r in mixed(d).collect()) for d in (docs, docs.repartition(2)))
    assert a == b


def test_mixture_repeats_rows(docs):
    copies = {r.doc_id: r.copies for r in mixed(docs).collect()}
    rows = mix(docs)
    assert rows.columns == docs.columns
    got = defaultdict(int)
    for r in rows.collect():
        got[r.doc_id] += 1
    assert got == {i: c for i, c in copies.items() if c}


def test_edges(no_docs, awkward):
    assert mixed(no_docs).collect() == []
    rows = mixed(awkward).collect()
    assert len(rows) == 6 and all(r.taken == 0 for r in rows if not r["size"])
    assert mix(awkward).columns == awkward.columns
