import itertools
import random

import pytest

from trailmark.llm.decontamination import MASKS, NEEDED, WINDOW, contamination, drop_contaminated


def test_mask_is_lossless():
    cared = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
    for wrong in itertools.combinations(range(WINDOW), WINDOW - NEEDED):
        assert any(not {s + i for i in m} & set(wrong) for m in cared for s in range(WINDOW - m[-1]))


def brute(docs, items, window=13, needed=11):
    split = lambda t: (t or "").lower().split()
    out = {}
    for i, t in docs:
        ws, met = split(t), 0
        for item in items:
            it = split(item)
            met += any(
                sum(0 <= d + k < len(ws) and ws[d + k] == it[k] for k in range(s, s + window)) >= needed
                for d in range(-len(it), len(ws)) for s in range(len(it) - window + 1)
            )
        out[i] = (met > 0, met)
    return out


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 3)))
    items = [" ".join(word() for _ in range(rng.randint(10, 40))) for _ in range(8)]
    docs = []
    for i in range(60):
        ws = [word() for _ in range(rng.randint(0, 40))]
        if i % 2:
            part = rng.choice(items).split()
            a = rng.randrange(len(part))
            part = part[a : a + rng.randint(8, 30)]
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = "ZZ"
            at = rng.randint(0, len(ws))
            ws[at:at] = part
        docs.append((i, " ".join(ws).title() if i % 5 == 0 else "\n ".join(ws)))
    return docs + [(100, None), (101, ""), (102, items[0].upper())], items


@pytest.mark.parametrize("bound", [1_000_000, 0])
@pytest.mark.parametrize("masks", [MASKS, ("11010011", "11001011")])
def test_against_brute_force(spark, leaks, bound, masks):
    docs, items = leaks
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, broadcast_seeds=bound, masks=masks)
    got = {r.doc_id: (r.contaminated, r.n_items) for r in found.collect()}
    assert got == brute(docs, items) and 10 < sum(c for c, _ in got.values()) < len(docs)


def test_edges(spark, no_docs, awkward, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "same words here")], "item_id long, text string")
    assert contamination(no_docs, odd).collect() == []
    assert not any(r.contaminated for r in contamination(docs, none).collect())
    kept = drop_contaminated(awkward, odd)
    assert kept.columns == awkward.columns and kept.count() == 6
    long = " ".join("same words here".split() * 5)
    twice = awkward.limit(0).unionByName(awkward.selectExpr(f"case when doc_id = 1 then '{long}' else text end as text", *[f"`{c}`" for c in awkward.columns if c != "text"]))
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    assert [r.n_items for r in contamination(twice, bench).collect() if r.doc_id == 1] == [1, 1]
    assert drop_contaminated(twice, bench).count() == 4


def test_long_item(spark):
    """The words of a long item beside each of its seeds are no small table."""
    from trailmark.llm.decontamination import may_broadcast, word_hashes

    rng = random.Random(5)
    long = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[:20]))], "item_id long, text string")
    items = bench.select("item_id", word_hashes("text").alias("item_words"))
    assert not may_broadcast(items, MASKS, 1_000_000) and may_broadcast(items.where("item_id = 2"), MASKS, 1_000_000)
    docs = spark.createDataFrame([(1, " ".join(long[1000:1013])), (2, "x " * 30), (3, " ".join(long))], "doc_id long, text string")
    assert {r.doc_id: r.n_items for r in contamination(docs, bench).collect()} == {1: 1, 2: 0, 3: 2}


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_whole_short_items(spark, leaks, bound):
    docs, items = leaks
    short = ["who wrote this", "a b", "Same question, in six short words?", "x y z w", None, "zz " * 12]
    texts = ["Who Wrote\nTHIS", "who wrote it", "a b", "is it the same question, in six short words? yes", "x y z", "w x y z w x y z w", "zz " * 11, "zz " * 30]
    docs = docs + [(200 + i, t) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(list(enumerate(items + short)), "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_items for r in contamination(frame, bench, broadcast_seeds=bound, whole_from=3).collect()}
    whole = lambda t: sum(3 <= len((s or "").split()) < 13 and f" {' '.join(s.lower().split())} " in f" {' '.join((t or '').lower().split())} " for s in items + short)
    assert got == {i: n + whole(t) for (i, t), (_, n) in zip(docs, brute(docs, items + [s or "" for s in short]).values())}
    assert [got[200 + i] for i in range(8)] == [1, 0, 0, 1, 0, 1, 0, 1]
    kept = {r.doc_id for r in drop_contaminated(frame, bench, broadcast_seeds=bound, whole_from=3).collect()}
    assert kept == {i for i, n in got.items() if not n}
