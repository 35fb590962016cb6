"""Perplexity by grams of unfolded characters, through blocks and sharded tables, against a dictionary version."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from trailmark.llm.kneser_ney import ORDER, UNITS, discounts, grams, scores
from trailmark.llm.text_blocks import pack, rows_of, text_blocks, unpack

ROWS = "key long, doc_id long, lang string, text string, train boolean"


def units(text):
    data = text.encode("utf-16-le")
    return [0] * (ORDER - 1) + [int.from_bytes(data[i : i + 2], "little") for i in range(0, len(data), 2)]


def plain_nll(trained, cuts):
    """Minus the log probability of a text by the textbook recursion over code units."""
    tables = [Counter(tuple(s[i - ORDER + 1 : i + 1]) for s in map(units, trained) for i in range(ORDER - 1, len(s)))]
    for _ in range(ORDER - 1):
        tables.append(Counter(g[1:] for g in tables[-1]))
    tables = tables[::-1]

    def p(gram):
        if not gram:
            return 1 / 65536
        cut = lambda c: cuts[len(gram) - 1][min(c, 3) - 1]
        own = {g: c for g, c in tables[len(gram) - 1].items() if g[:-1] == gram[:-1]}
        total, c = sum(own.values()), own.get(gram, 0)
        if not total:
            return p(gram[1:])
        return (max(c - cut(c), 0) if c else 0) / total + sum(map(cut, own.values())) / total * p(gram[1:])

    return lambda text: -sum(math.log(p(tuple(s[i - ORDER + 1 : i + 1]))) for s in [units(text)] for i in range(ORDER - 1, len(s)))


def test_scores_agree_with_the_recursion(spark):
    texts = ["река под мостом", "старый мост", "мост и река", "日本語の本", "an old house 😀😁", "the river, the house"]
    others = ["мопт и реша", "日木語", "😁😀", "zzz", None, "", " ￿"]
    rows = [(i, i, "a", t, i < len(texts)) for i, t in enumerate(texts + others)]
    blocks = text_blocks(spark.createDataFrame(rows, ROWS).repartition(3))
    assert blocks.table.count() == 3
    tables = [Counter(tuple(s[i - ORDER + 1 : i + 1]) for s in map(units, texts) for i in range(ORDER - 1, len(s)))]
    for _ in range(ORDER - 1):
        tables.append(Counter(g[1:] for g in tables[-1]))
    cuts = [discounts(spark.createDataFrame([(c,) for c in t.values()], "count long")) for t in tables[::-1]]
    nll = plain_nll(texts, cuts)
    got = {r.key: r for r in scores(blocks).collect()}
    assert len(got) == len(rows)
    for key, _, _, text, _ in rows:
        assert got[key].n == len(text or "")
        assert got[key].nll == pytest.approx(nll(text or ""))


def test_letters_of_other_scripts_are_told_apart(spark):
    """Under character classes both texts have the same perplexity."""
    rows = [(i, i, "a", "река мост вода дом " * 3, True) for i in range(9)] + [(10, 10, "a", "река мост вода дом", False), (11, 11, "a", "ымлу щгъф юцжэ фыш", False)]
    got = {r.key: r.nll for r in scores(text_blocks(spark.createDataFrame(rows, ROWS).repartition(2))).collect()}
    assert got[11] > 3 * got[10]


def test_packing():
    rng = np.random.default_rng(1)
    a, b, c = rng.integers(-(2**63), 2**63 - 1, 999), rng.integers(0, 9, 999), rng.random(999)
    for got, want in zip(unpack(pack(a, b, c), np.int64, np.int64, np.float64), (a, b, c), strict=True):
        assert (got == want).all()
    empty = np.empty(0, np.int64)
    assert [len(x) for x in unpack(pack(empty, empty), np.int64, np.int64)] == [0, 0]


def test_grams_over_pieces(monkeypatch):
    import trailmark.llm.kneser_ney as module

    text = "".join(random.Random(2).choice("aбв日😀") for _ in range(50))
    whole = np.concatenate(list(grams(text, UNITS)))
    monkeypatch.setattr(module, "PIECE", 7)
    assert (np.concatenate(list(grams(text, UNITS))) == whole).all() and len(whole) == len(units(text)) - ORDER + 1


def test_blocks_keep_their_rows(spark):
    rows = [(i, i if i % 3 else None, [None, "x"][i % 2], [None, "", "a\0b"][i % 3], i % 2 > 0) for i in range(30)]
    blocks = text_blocks(spark.createDataFrame(rows, ROWS).repartition(4)).table.collect()
    found = [tuple(r[c] for c in ("key", "doc_id", "lang", "text", "train")) for b in blocks for r in rows_of(bytes(b.held)).to_pylist()]
    assert sorted(found) == sorted(rows)


def test_blocks_of_stored_rows_need_no_table(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, i, "a", " ".join(rng.choice("old house by the river".split()) for _ in range(20)), i % 3 > 0) for i in range(60)]
    spark.createDataFrame(rows, ROWS).repartition(3).write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    kept, made = (sorted(map(tuple, scores(text_blocks(stored, keep)).collect())) for keep in (True, False))
    assert len(kept) == 60 and kept == made


def test_rows_that_change_are_an_error(spark):
    rows = spark.createDataFrame([(i, i, "a", "some text", True) for i in range(9)], ROWS)
    from pyspark.sql import functions as F

    # The key differs in each read.
    changing = rows.withColumn("key", F.unhex(F.substr(F.replace(F.expr("uuid()"), F.lit("-")), F.lit(1), F.lit(6))).cast("binary"))
    changing = changing.withColumn("key", F.xxhash64("key", F.current_timestamp()))
    blocks = text_blocks(changing, keep=False)
    with pytest.raises(Exception, match="changed between two reads|answers"):
        scores(blocks).collect()
