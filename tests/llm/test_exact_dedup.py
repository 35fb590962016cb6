import hashlib
import re

from pyspark.sql import functions as F

from trailmark.llm.exact_dedup import drop_duplicates, exact_duplicates


def expected(corpus):
    groups = {}
    normal = {i: re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for i, t, *_ in corpus}
    for i, t in normal.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in normal.items()}


def test_against_brute_force(docs, corpus):
    assert {r[0]: tuple(r)[1:] for r in exact_duplicates(docs).collect()} == expected(corpus)


def test_colliding_hashes_are_told_apart_by_their_bytes(docs, corpus):
    found = exact_duplicates(docs, fingerprint=lambda text: F.substring(F.md5(text), 1, 1))
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == expected(corpus)


def test_edges(no_docs, awkward):
    assert exact_duplicates(no_docs).collect() == []
    rows = {(r.doc_id, r.text_sha256[:4], r.keep_id, r.group_size, r.kept) for r in exact_duplicates(awkward).collect()}
    same, none = hashlib.sha256(b"same words here").hexdigest()[:4], hashlib.sha256(b"").hexdigest()[:4]
    assert rows == {(1, same, 1, 3, True), (None, same, 1, 3, False), (None, none, 2, 3, False), (2, none, 2, 3, True), (3, none, 2, 3, False)}
    assert sorted(r.doc_id for r in drop_duplicates(awkward).collect()) == [1, 2]
    assert drop_duplicates(awkward).columns == awkward.columns
