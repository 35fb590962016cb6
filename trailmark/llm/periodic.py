"""Detection and collapse of periodic stretches of words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.lyndon import runs
from trailmark.llm.slices import SLICE_BYTES, sliced, text_bytes
from trailmark.llm.tokens import BASE, gram_hashes, mix

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
DDL = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def recurring(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each stretch covered by windows of ``width`` words that recur in their document."""
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keys = gram_hashes(mix((words + 1).astype(np.uint64) * BASE), width) ^ mix(document[:n].astype(np.uint64) + np.uint64(1))
    whole = document[:n] == document[width - 1 :]
    ordered = np.sort(keys[whole])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    near = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    starts = np.flatnonzero((twice[near] == keys) & whole)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) > width) | (np.diff(document[starts]) != 0)
    heads = np.flatnonzero(new)
    return starts[heads], starts[np.append(heads[1:], len(starts)) - 1] + width


def collapse(ids: pa.Array, texts: pa.Array, least: int, times: int) -> pa.RecordBatch:
    data, rows = text_bytes(texts)
    raw = data.tobytes()
    documents = [raw[a:b].split() for a, b in zip(rows[:-1], rows[1:])]
    offsets = np.cumsum([0, *map(len, documents)])
    numbers = defaultdict(count().__next__)
    words = np.fromiter((numbers[w] for d in documents for w in d), np.int64, int(offsets[-1]))
    # max(least, times * q) - q is least at q = least / times: so many words of any run equal those a period on.
    first, end = recurring(words, offsets, least - least // times)
    long = end - first >= least
    first, end = first[long], end[long]
    found = runs([words[a:b] for a, b in zip(first, end)], least, times)
    start = first[found[:, 0]] + found[:, 1]
    document = np.searchsorted(offsets, start, side="right") - 1
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, start + found[:, 3], 1)
    np.add.at(gone, start + found[:, 2], -1)
    kept = np.cumsum(gone[:-1]) == 0
    of_document = np.searchsorted(document, np.arange(len(documents) + 1))
    struct = pa.StructArray.from_arrays([pa.array(c) for c in (start - offsets[document], found[:, 2], found[:, 3])], fields=list(RUNS.value_type))
    listed = pa.ListArray.from_arrays(pa.array(of_document, pa.int32()), struct)
    some = np.diff(of_document) > 0
    text = [
        b" ".join(compress(d, kept[offsets[i] : offsets[i + 1]].tolist()) if some[i] else d) for i, d in enumerate(documents)
    ]
    return pa.RecordBatch.from_arrays([ids, listed, pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])


def collapsed_runs(docs: DataFrame, least: int = 24, times: int = 3, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, runs and collapsed of every row of (doc_id, text).

    A run is a stretch of words in which words one period apart are equal, of ``least`` words and ``times`` periods
    or more (``times`` is 2 at least), that no neighbouring word extends. ``runs`` holds start, length and smallest period
    of each, ordered by start, then period. ``collapsed`` joins by single spaces the words that no run holds after its
    first period. A run lies inside a stretch whose shorter windows recur in the document; only such stretches are searched.

    A null or empty text has no runs and collapses to the empty text; a null id stays null; repeated rows give a row each;
    no rows give none. Other columns are ignored. Rows are judged where they are read: nothing is shuffled. A task
    holds the words of ``slice_bytes`` of text at a time, or of one document if that is longer.
    """
    if times < 2 or least < times:
        raise ValueError("a run has two periods or more, and a word in each")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, most=slice_bytes):
            yield collapse(batch["doc_id"], batch["text"], least, times)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(search, DDL)


def most_periods(found: str | Column) -> Column:
    """Of an array of runs, the one with most periods, compared as fractions; then the least start and period."""
    column = F.col(found) if isinstance(found, str) else found
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    first = F.get(column, F.lit(0))
    return F.when(F.size(column) > 0, F.aggregate(column, first, lambda best, r: F.when(more(r, best), r).otherwise(best)))
