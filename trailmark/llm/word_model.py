"""How well the words of a document are known from trusted text, with counts that grow with the corpus."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.text_blocks import ASKED, Blocks, answered, answers, asked, asking_order, judged_rows, questions, text_blocks

# Scripts written without spaces are taken character by character: Thai to Burmese, Khmer, kana, Han.
UNSPACED = r"฀-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
WORD_SCORES = "n_words long, word_nll double, worst double"
WORDS = re.compile(rf"[{UNSPACED}]|[^\s\x00-/:-@\[-`{{-\xbf -⁯　-〿＀-／{UNSPACED}]+")


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Numbers(dict):
    """Numbers new keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def word_numbers(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each distinct word; for each row the number of its language's empty word, and how many words it has; numbers of all words.

    A word is counted in its language, and the empty word stands for all words of a language.
    """
    known, found, of = {}, [], []
    for lang, text in zip(rows["lang"].to_pylist(), rows["text"], strict=True):
        lang = "0" if lang is None else f"1{lang}"
        if lang not in known:
            known[lang] = _Numbers({"": 0})
        words = WORDS.findall((text.as_py() or "").lower())
        found.append(np.fromiter(map(known[lang].__getitem__, words), np.int64, len(words)))
        of.append(lang)
    starts = dict(zip(known, np.cumsum([0, *map(len, known.values())]).tolist()))
    hashes = np.fromiter((word_hash(f"{lang}\0{w}") for lang, ws in known.items() for w in ws), np.int64)
    wholes, n = np.array([starts[lang] for lang in of], np.int64), np.array([len(f) for f in found], np.int64)
    return hashes, wholes, n, np.concatenate(found) + np.repeat(wholes, n)


def distinct_words(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a block, with their occurrences in rows to train on and in all rows."""
    hashes, wholes, n, numbers = word_numbers(rows)
    train = rows["train"].to_numpy()

    def counts(weight: np.ndarray) -> np.ndarray:
        each = np.bincount(numbers, np.repeat(weight, n), len(hashes)) + np.bincount(wholes, weight * n, len(hashes))
        return each.astype(np.int64)

    return hashes, counts(train.astype(np.int64)), counts(np.ones(len(n), np.int64))


def word_counts(blocks: Blocks) -> DataFrame:
    """block, part, held: to each block the counts of its words in rows to train on and in all rows of the corpus."""

    def total(group: pa.Table) -> pa.Table:
        hashes, counts, ends = questions(group, 2)
        _, at = np.unique(hashes, return_inverse=True)
        return answers(group, ends, *[np.bincount(at, c)[at].astype(np.int64) for c in counts])

    return asked(blocks, distinct_words).groupBy("part").applyInArrow(total, ASKED)


def judge_words(rows: pa.Table, group: pa.Table, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n_words, word_nll and worst of the rows of a block, given its answers from ``word_counts``.

    ``word_nll`` is minus the log probability of all words under the counts of the language's rows to train on, with
    half an occurrence of prior for each word. ``worst`` is the least log ratio, over the words, of the occurrences in
    trusted text to those expected there from the whole corpus of the language: a word common in the corpus that trusted text
    avoids is far below 0, a rare one near 0.
    """
    hashes, wholes, n, numbers = word_numbers(rows)
    trained, seen = (v.astype(np.float64) for v in answered(group, asking_order(hashes, parts)[0], np.int64, np.int64))
    docs, whole = np.repeat(np.arange(len(n)), n), np.repeat(wholes, n)
    cost = -np.log((trained[numbers] + 0.5) / (trained[whole] + 1.0))
    ratio = np.log((trained[numbers] + 1.0) / (seen[numbers] * trained[whole] / seen[whole] + 1.0))
    worst = np.full(len(n), np.inf)
    np.minimum.at(worst, docs, ratio)
    return n, np.bincount(docs, cost, len(n)).astype(np.float64), np.where(np.isinf(worst), 0.0, worst)


def word_scores(rows: DataFrame) -> DataFrame:
    """key, n_words, word_nll, worst of every row of (key, lang, text, train), by the words alone."""
    blocks = text_blocks(rows.withColumn("doc_id", F.lit(None).cast("long")))
    parts = blocks.parts
    found = judged_rows(blocks, [word_counts(blocks)], lambda held, groups: judge_words(held, groups[0], parts), WORD_SCORES)
    return found.drop("doc_id", "lang")
