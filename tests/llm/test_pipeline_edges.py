"""The whole pipeline over odd rows: nulls, empty texts, repeated rows, clashing columns, no rows at all."""

import random

import corpus_pipeline

LABELS = "doc_id long, quality long, toxic long"


def tables(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    draw = random.Random(4)
    text = lambda n: " ".join(draw.choice("river stone light water field house green road under over".split()) + str(draw.randrange(40)) for _ in range(n))
    rows = [(i, text(draw.randint(30, 80)), "en" if i % 3 else None, f"s{i % 4}") for i in range(60)]
    rows += [(100, None, "en", "s0"), (101, "", None, None), (None, text(40), "en", "s1"), rows[5], rows[5], (102, " \n", "de", "s9"), (103, rows[7][1], "en", "s2")]
    rows += [(104, text(20) + " where does the river end " + text(20), "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = docs.selectExpr("*", "1 as kept", "2 as shard", "3 as row", "4 as key", "5 as copies", "'x' as size")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(None, 1, 0), (999, 0, 1)]
    folder = tables(spark, tmp_path, extra, labels, [(1, "Where does the river end"), (2, None), (None, "")])
    found = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in found}
    assert ids <= {r[0] for r in rows} and len(ids) > 30
    assert 104 not in ids  # it holds a short item of the benchmark
    assert not {7, 103} <= ids  # of equal texts one stays
    assert {r.shard for r in found} <= set(range(16))


def test_no_documents(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, none, [(1, 1, 0)], [(1, "a b c d")])).collect() == []
