"""Similar sets against brute force."""

import random

import brute
import numpy as np
import pytest

from trailmark.llm import jaccard
from trailmark.llm.components import connected
from trailmark.llm.jaccard import differing, drop_similar, linked_sets, parity_map, similar_documents
from trailmark.llm.prefix_tree import links


@pytest.mark.parametrize("seed", range(40))
def test_prefix_tree(seed):
    rng = np.random.default_rng(seed)
    base = rng.choice(60, 30, replace=False)
    sets = []
    for _ in range(int(rng.integers(1, 40))):
        s = set(base.tolist()) if rng.random() < 0.7 else set(rng.choice(60, int(rng.integers(1, 30))).tolist())
        for _ in range(int(rng.integers(0, 5))):
            s ^= {int(rng.integers(0, 60))}
        sets.append(s)
    num, den = [(9, 10), (4, 5), (1, 2)][seed % 3]
    extra = rng.integers(0, 3, len(sets))
    found = links([np.array(sorted(s), np.int64) for s in sets], np.array([len(s) for s in sets]) + extra, (num, den), list(range(len(sets))))
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if den * n >= num * (len(sets[i]) + extra[i] + len(sets[j]) + extra[j] - n):
                up[max(find(i), find(j))] = min(find(i), find(j))
    same = lambda f: [[f(i) == f(j) for j in range(len(sets))] for i in range(len(sets))]
    assert same(found.find) == same(find)


@pytest.mark.parametrize("words, enough, chunk", [(3, (9, 10), 500), (5, (4, 5), 500), (3, (1, 2), 3), (1, (3, 10), 5)])
def test_against_brute_force(docs, corpus, words, enough, chunk):
    got = {r[0]: tuple(r)[1:] for r in similar_documents(docs, words, enough, chunk=chunk).collect()}
    assert got == brute.similar_components([(i, t) for i, t, *_ in corpus], words, enough)
    assert len({c for _, c in got.values()}) < len(got)


def test_connected(spark):
    rng = random.Random(1)
    pairs = [(i, i // 2) for i in range(40)] + [(i, i - 1 + 1000) for i in range(100, 160)] + [(i, i + 1000) for i in range(100, 160)]
    pairs += [(rng.randrange(200, 300), rng.randrange(5000, 5060)) for _ in range(80)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for n, h in pairs:
        up[find(("h", h))] = find(n)
    least = {}
    for n, _ in pairs:
        least[find(n)] = min(least.get(find(n), n), n)
    got = connected(spark.createDataFrame(pairs, "node long, hub long"))
    assert {r.node: r.label for r in got.collect()} == {n: least[find(n)] for n, _ in pairs}


def test_one_of_each_component_stays(docs, corpus):
    groups = brute.similar_components([(i, t) for i, t, *_ in corpus])
    kept = drop_similar(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert kept.columns == docs.columns


def test_edges(no_docs, awkward):
    assert similar_documents(no_docs).collect() == []
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_documents(awkward).collect())
    assert got == [("1", 1, "1"), ("1", 1, "1"), ("2", 0, "2"), ("3", 0, "3"), ("None", 0, "None"), ("None", 1, "1")]
    assert drop_similar(awkward).columns == awkward.columns


def classes_of(spark, sets):
    """The distinct sets as (node, n, elements, parity): elements of one set only are left out, the others rare ones first."""
    often = {}
    for s in sets:
        for e in s:
            often[e] = often.get(e, 0) + 1
    rows = []
    for i, s in enumerate(sets):
        elements = sorted(min(often[e], 127) << 56 | e for e in s if often[e] > 1)
        if elements:
            rows.append((i, len(s), elements, bytearray(parity_map(np.array(elements, np.uint64), len(s)))))
    return spark.createDataFrame(rows, "node long, n long, elements array<long>, parity binary")


def test_chance_does_not_connect(spark, monkeypatch):
    """Sets in a chain of rare common elements are no candidates, so they are not dealt out to be compared."""
    counts = {}

    def counting(df, name):
        out = written(df, name)
        counts[name] = out.count()
        return out

    written = jaccard.written
    rng = np.random.default_rng(2)
    frequent = [int(e) for e in rng.choice(1 << 40, 400, replace=False)]
    sets = [{1000 + i, 1001 + i, *(frequent[j] for j in rng.choice(400, 60, replace=False))} for i in range(600)]
    sets.append(set(sorted(sets[9])[1:]))
    monkeypatch.setattr(jaccard, "written", counting)
    got = {r.node: r.label for r in linked_sets(classes_of(spark, sets), (9, 10), 250).collect()}
    assert got == {9: 9, 600: 9} and counts["dealt-sets"] == 2


@pytest.mark.parametrize("seed, enough, chunk", [(1, (9, 10), 2), (2, (4, 5), 3), (3, (1, 2), 2), (4, (4, 5), 250)])
def test_frequent_heads(spark, seed, enough, chunk):
    """Large families of similar sets and sets that only share rare elements, in heads of many chunks."""
    rng = np.random.default_rng(seed)
    draw = lambda n: {int(e) for e in rng.integers(1, 1 << 40, n)}
    sets = []
    for family in range(6):
        base = draw(40)
        for _ in range(3 + 12 * family):
            gone = set(rng.choice(sorted(base), int(rng.integers(0, 6)), replace=False).tolist())
            sets.append((base - gone) | draw(int(rng.integers(0, 4))))
    common = draw(3)
    sets += [common | draw(int(rng.integers(0, 2))) for _ in range(40)]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    num, den = enough
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if den * len(x & y) >= num * len(x | y):
                up[max(find(i), find(j))] = min(find(i), find(j))
    assert len({find(i) for i in up}) < len(sets) - 40
    first = {}
    kept = [i for i, s in enumerate(sets) if first.setdefault(frozenset(s), i) == i]  # distinct sets, as in classes
    distinct = classes_of(spark, sets)
    distinct = distinct.where(distinct.node.isin(kept))
    got = {r.node: r.label for r in linked_sets(distinct, enough, chunk).collect()}
    assert [find(i) for i in kept] == [find(got.get(i, i)) for i in kept]
    assert all(find(i) == i or i in got for i in kept)


def test_parity_maps():
    rng = np.random.default_rng(5)
    for n in (1, 30, 600, 3000):
        x = rng.integers(1, 1 << 60, n).astype(np.uint64)
        y = np.concatenate([x[: n // 2], rng.integers(1, 1 << 60, 2 * n).astype(np.uint64)])
        maps = parity_map(x, len(x)), parity_map(y, len(y))
        apart = len(set(x.tolist()) ^ set(y.tolist()))
        assert apart / 4 < differing(*maps) == differing(*maps[::-1]) <= apart and differing(maps[0], maps[0]) == 0
