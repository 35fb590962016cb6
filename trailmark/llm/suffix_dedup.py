"""Removal of repeated byte strings by longest-previous-factor arrays over suffix arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trailmark.llm.tokens import BYTE_CODES
from trailmark.llm.windows import Plan, Segments, schema, search, spread


class Bytes:
    """The tokens of a block are its bytes."""

    def __call__(self, data, rows):
        return (lambda a, b: BYTE_CODES[data[a:b]]), rows, None

    def take(self, data, x, places):
        return data[places]


def suffix_order(text: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in order of their first ``width`` bytes, and the common prefix of
    each with the one before it (at most ``width``)."""
    lanes = -(-width // 8)
    padded = np.concatenate([text, np.zeros(8 * lanes, np.uint8)])
    keys = np.zeros((lanes, len(starts)), np.uint64)
    for i in range(width):
        keys[i // 8] |= padded[starts + i].astype(np.uint64) << np.uint64(56 - 8 * (i % 8))
    order = np.lexsort(keys[::-1])
    common = np.zeros(len(starts), np.int64)
    open_ = np.arange(1, len(starts))
    for lane in keys:
        differ = lane[order[open_]] ^ lane[order[open_ - 1]]
        # The highest byte that differs ends the common prefix.
        equal = np.zeros(len(open_), np.int64)
        rest = differ.copy()
        for shift in (32, 16, 8):
            high = rest >> np.uint64(64 - shift) == 0
            equal += np.where(high & (rest != 0), shift // 8, 0)
            rest = np.where(high, rest << np.uint64(shift), rest)
        common[open_] += np.where(differ == 0, 8, equal)
        open_ = open_[differ == 0]
    return order, np.minimum(common, width)


def previous_smaller(value: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each suffix with the nearest one before it in suffix order of smaller value.

    Pointers start at the neighbour and jump along the pointers found so far, which halves the
    way left each round; what is jumped over has no smaller value. The prefix in common is
    the least on the way. Below ``least`` the search ends with 0.
    """
    n = len(value)
    to = np.arange(-1, n - 1)
    shared = common.copy()
    shared[:1] = 0
    todo = np.arange(n)
    while len(todo):
        dead = (to[todo] < 0) | (shared[todo] < least)
        shared[todo[dead]] = 0
        to[todo[dead]] = -1
        todo = todo[~dead]
        todo = todo[value[to[todo]] >= value[todo]]
        via = to[todo]
        step_to, step_shared = to[via], np.minimum(shared[todo], np.where(to[via] < 0, 0, shared[via]))
        to[todo], shared[todo] = step_to, step_shared
    return shared


def longest_previous_factor(text: np.ndarray, starts: np.ndarray, value: np.ndarray, width: int, least: int) -> np.ndarray:
    """For each suffix, the longest prefix (at most ``width``) that a suffix of smaller value has too.

    The longest match among all smaller values is with the nearest of them on one side in
    suffix order, so the previous and the next smaller suffice. Matches below ``least`` count as 0.
    """
    if not len(starts):
        return np.empty(0, np.int64)
    order, common = suffix_order(text, starts, width)
    ordered = value[order]
    before = previous_smaller(ordered, common, least)
    mirrored = np.concatenate([[0], common[1:][::-1]])
    after = previous_smaller(ordered[::-1], mirrored, least)[::-1]
    out = np.empty(len(starts), np.int64)
    out[order] = np.maximum(before, after)
    return out


def earlier_in_smaller_document(segments: Segments) -> np.ndarray:
    """Whether each window of the segments also starts in a document with a smaller id."""
    starts = spread(segments.bounds[:-1], segments.n)
    value = np.repeat(segments.ids, segments.n)
    found = longest_previous_factor(segments.tokens, starts, value, segments.width, segments.width)
    return found >= segments.width


class KeptBytes:
    """Per document: its length, what is removed, and the rest."""

    schema = schema("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

    def __init__(self, texts: bool):
        self.texts = texts

    def empty(self) -> pa.Table:
        return self.columns.empty_table()

    @property
    def columns(self) -> pa.Schema:
        return self.schema if self.texts else self.schema.remove(5)

    def __call__(self, ids, data, rows, offsets, covered, _):
        sums = np.concatenate([[0], np.cumsum(covered)])
        removed = np.diff(sums[rows])
        begins = covered.copy()
        begins[1:] &= ~covered[:-1]
        heads = rows[:-1][np.diff(rows) > 0]
        begins[heads] = covered[heads]
        spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[rows])
        kept = data[~covered].tobytes()
        at = (rows - sums[rows]).tolist()
        parts = [kept[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        shas = [hashlib.sha256(p).hexdigest() for p in parts]
        columns = [ids, np.diff(rows), removed, spans, shas, *([parts] if self.texts else [])]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, self.columns, strict=True)], schema=self.columns)


def remove_repeats(docs: DataFrame, width: int = 50, gram: int = 20, texts: bool = True, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of every row of (doc_id, text).

    Removed is each byte covered by a string of ``width`` bytes that also starts in a document of smaller
    id; strings are judged on the input and never cross documents. The first document
    that holds a string keeps it. A null text is empty; a null id comes after all others; rows of one
    id count as one document; a text shorter than ``width`` loses nothing. Other columns are ignored.
    """
    finish = KeptBytes(texts)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    plan = Plan(width, gram, Bytes(), earlier_in_smaller_document, finish, ddl, same_document=False)
    return search(docs, Plan(**{**plan.__dict__, **options}))
