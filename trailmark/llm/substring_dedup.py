"""Removal of repeated word sequences with a compressed FM-index per shard."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trailmark.llm.fm_index import FMIndex, least_in
from trailmark.llm.tokens import word_bounds, word_hashes
from trailmark.llm.windows import Plan, Segments, schema, search, spread


class Words:
    """The tokens of a block are hashes of its words; equal words are equal but for a 64-bit collision."""

    def __call__(self, data, rows):
        starts, ends, offsets = word_bounds(data, rows)
        hashes = word_hashes(data, starts, ends)
        return (lambda a, b: hashes[a:b]), offsets, None

    def take(self, data, x, places):
        return x(0, None)[places]


def earlier_copy(segments: Segments) -> np.ndarray:
    """Whether each window of the segments occurs earlier: in a smaller document, or before in its own.

    The segments are indexed, and streamed against the index: an interval is reported where the matching
    statistic reaches the width and the suffix range holds an earlier place than the window's own.
    """
    width, n = segments.width, segments.n
    if not len(n):
        return np.empty(0, bool)
    _, symbols = np.unique(segments.tokens, return_inverse=True)
    bounds = segments.bounds
    length = n + width - 1
    # One separator after each segment.
    at = spread(bounds[:-1] + np.arange(len(n)), length)
    text = np.zeros(len(segments.tokens) + len(n), np.int64)
    text[at] = symbols + 1
    place = np.empty(len(n), np.int64)
    place[np.lexsort([segments.starts, segments.ids])] = np.arange(len(n))
    # Windows in the order of the corpus; a segment has fewer than 256 positions with windows.
    where = np.full(len(text), np.iinfo(np.int64).max)
    first = bounds[:-1] + np.arange(len(n))
    windows = spread(first, n)
    own = np.repeat(place << 8, n) + spread(np.zeros(len(n), np.int64), n)
    where[windows] = own
    index = FMIndex(text, int(symbols.max()) + 2, width)
    matched, low, high = index.matching_statistics(text, windows + width, width)
    full = matched == width
    found = np.zeros(len(windows), bool)
    found[full] = least_in(where[index.suffixes], low[full], high[full]) < own[full]
    return found


class KeptWords:
    """Per document: its words, what is removed, and the rest joined by single spaces."""

    schema = schema("doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")

    def __init__(self, texts: bool):
        self.texts = texts

    @property
    def columns(self) -> pa.Schema:
        return self.schema if self.texts else self.schema.remove(4)

    def empty(self) -> pa.Table:
        return self.columns.empty_table()

    def __call__(self, ids, data, rows, offsets, covered, _):
        removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[offsets])
        kept, shas = [], []
        for i in range(len(rows) - 1):
            found = data[rows[i] : rows[i + 1]].tobytes().split()
            if removed[i]:
                found = compress(found, (~covered[offsets[i] : offsets[i + 1]]).tolist())
            text = b" ".join(found)
            shas.append(hashlib.sha256(text).hexdigest())
            if self.texts:
                kept.append(text)
        columns = [ids, np.diff(offsets), removed, shas]
        if self.texts:
            columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
        return pa.table([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, self.columns, strict=True)], schema=self.columns)


def remove_repeats(docs: DataFrame, width: int = 20, gram: int = 5, texts: bool = True, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (text) of every row of (doc_id, text).

    Removed is each word covered by a window of ``width`` words that also starts earlier: in a document
    of smaller id, or before in the same one. Windows are judged on the input and never cross documents.
    A null text has no words; a null id comes after all others; rows of one id are one document whose
    parts follow each other by text; fewer than ``width`` words lose nothing. Other columns are ignored.
    """
    finish = KeptWords(texts)
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")
    plan = Plan(width, gram, Words(), earlier_copy, finish, ddl, same_document=True)
    return search(docs, Plan(**{**plan.__dict__, **options}))
