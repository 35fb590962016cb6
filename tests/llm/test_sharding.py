import zlib
from collections import Counter

import pytest

from trailmark.llm.sharding import sharded


def check(rows, shards):
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(shards))
    return sizes


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_near_equal_bytes(spark, shards):
    texts = [(i, "ab c" * (i % 40)) for i in range(3000)]
    rows = sharded(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), shards).collect()
    sizes = check(rows, shards)
    fair = sum(sizes.values()) / shards
    assert len(sizes) == shards and all(abs(s - fair) <= 0.02 * fair + 161 for s in sizes.values())
    for r in rows:
        assert r["size"] == len(r.text) + 1 and r.text_crc32 == zlib.crc32(r.text.encode())


def test_one_text_of_all_rows_is_cut(spark):
    rows = sharded(spark.range(2000).selectExpr("id as doc_id", "'the same text' as text"), 8).collect()
    sizes = check(rows, 8)
    assert max(sizes.values()) - min(sizes.values()) <= 0.04 * 14 * 250


def test_groups_stay_together_within_the_tolerance(spark):
    texts = [(i, f"text {i // 4}") for i in range(4000)]
    rows = sharded(spark.createDataFrame(texts, "doc_id long, text string"), 16).collect()
    places = {}
    for r in rows:
        places.setdefault(r.text, set()).add(r.shard)
    assert all(len(p) == 1 for p in places.values())


def test_reruns_agree(docs):
    runs = [sorted((r.doc_id, r.shard, r.slot) for r in sharded(d, 4).collect()) for d in (docs, docs.repartition(3))]
    assert runs[0] == runs[1]


def test_edges(no_docs, awkward):
    assert sharded(no_docs).collect() == []
    out = sharded(awkward)
    rows = out.collect()
    assert len(rows) == 6 and set(awkward.columns) <= set(out.columns)
    check(rows, 16)
    assert {r["size"] for r in rows if not r.text} == {1}
