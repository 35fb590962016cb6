"""The pipeline and the registered queries over the small tables."""

import os
import sys
from collections import Counter

import corpus_pipeline
import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(corpus_pipeline.__file__), "tools"))
from check_oracles import TABLES, compare  # noqa: E402

from trailmark.llm import decontamination, jaccard, kneser_ney, mixing  # noqa: E402
from trailmark.llm.queries import ORACLES, QUERIES  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, sf), f"test-{number}")
        seen.append(docs)
        if number < 4:
            assert docs.columns == columns
    ids = [Counter(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    assert set(ids[1]) == {r.doc_id for r in kneser_ney.judged(seen[0], labels).collect() if r.kept}
    groups = {r.doc_id: r.component_id for r in jaccard.similar_documents(seen[1]).collect()}
    assert set(ids[2]) == {i for i, c in groups.items() if i == c} and len(ids[2]) < len(ids[1])
    assert set(ids[3]) == {r.doc_id for r in decontamination.contamination(seen[2], bench).collect() if not r.contaminated}
    assert ids[4] == Counter({r.doc_id: r.copies for r in mixing.mixed(seen[3]).collect() if r.copies})
    assert ids[5] == ids[4]
    sizes = Counter()
    for r in seen[5].collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 16


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    table = "pages" if name in ("op3_html_extraction", "op10_warc") else "documents"
    if name != "op13_spelling_variants":  # a row per word
        assert len(rows) == spark.read.parquet(f"{sf}/{table}.parquet").count()
    if name in ORACLES:
        duck = duckdb.connect()
        for t in TABLES:
            duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        found = duck.execute(ORACLES[name])
        columns = [d[0] for d in found.description]
        assert compare(rows, df.columns, found.fetchall(), columns) is None
