import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

WORDS = "the of and to in is it that for was on are as with his they at be this from".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "ed", "er"]) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, odd and missing texts."""
    rng = random.Random(4)
    passage = prose(rng, 45)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts = list(base)
    texts += [base[i] for i in (0, 0, 3, 7, 7, 7)]
    for i in range(12):
        words = base[i + 5].split()
        for _ in range(1 + i % 4):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        texts.append(" ".join(words))
    texts += [f"{prose(rng, 12)} {passage} {prose(rng, 9)}" for _ in range(14)]
    texts += [passage, passage + " " + passage, "a " * 300, "Ä ö é " * 30, "tab\tand\nline  breaks\r\n here\x0b\x0c", prose(rng, 3000)]
    texts += ["", "", None, None, " \n\t ", "one", "one two", "ONE two", "日本語 テキスト " * 20, "x" * 5000]
    rng.shuffle(texts)
    return [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["b", "a", "c", None, "a", "a"])) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in corpus]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids, repeated rows, and columns whose names the operators use themselves."""
    rows = [(1, "same words here", "en", "a"), (1, "same words here", "en", "a"), (None, "same words here", None, None), (None, None, None, None), (2, None, "de", "b"), (3, "", "de", "b")]
    clash = ["block", "part", "size", "shard", "slot", "hub", "node", "label", "copies", "kept", "seed", "row_key", "__key", "__id", "print", "n"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for i, name in enumerate(clash):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(i))
    return df
