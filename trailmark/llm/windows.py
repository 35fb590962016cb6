"""Repeated windows of tokens over a whole corpus, found in shards that meet by content.

Documents lie in blocks. Every window of ``width`` tokens belongs to its minimizer, the gram of ``gram``
tokens with the least hash in it; consecutive windows of one minimizer form a segment. Equal
windows have equal minimizers, so a shard chosen by the minimizer sees all copies of a window.

1. Each block sends the distinct minimizers of its windows, four bytes each; a minimizer met once in
   the corpus cannot lie in a repeated window, and its windows are done with.
2. Each block sends the distinct segments of the others, with the place of their first copy. Copies
   inside a block are combined there, so a passage in a third of all documents is sent once a block.
3. A shard says for every window of a segment whether an earlier copy exists (by the engine given).
4. Each block applies the answers to its documents.

Minimizers with very many copies, whose segments differ around a common passage, are sent window by
window and dealt by the window, so they spread over all shards. All documents are read once and
shuffled once by block; the three block passes share that shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.tokens import CHUNK, gram_hashes, in_order, mix, pack, sliding_min, unpack, window_hashes

BLOCK_BYTES = 4 << 20
LEAST_BLOCKS = 64
POSITION_BITS = np.uint64(22)

GRAMS = "part int, block int, hashes binary, counts binary"
ANSWERS = "block int, step int, part int, bits binary"
SEGMENTS = "part int, block int, n binary, prints binary, ids binary, starts binary, words binary, tokens binary"
arrow = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}


def schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], arrow[c.split()[1]]) for c in ddl.split(", ")])


@dataclass(frozen=True)
class Segments:
    """Distinct segments of one shard. ``tokens`` holds n[i] + width - 1 symbols of each in turn."""

    n: np.ndarray
    tokens: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    width: int

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.n + self.width - 1)])


@dataclass(frozen=True)
class Plan:
    """What a search looks for. ``codes`` gives the tokens of a block; ``engine`` answers in a shard.

    ``same_document``: a window may also repeat an earlier one of its own document.
    ``hot``: number of copies from which a minimizer's windows are dealt one by one.
    """

    width: int
    gram: int
    codes: Callable
    engine: Callable[[Segments], np.ndarray]
    finish: Callable
    output: str
    same_document: bool
    parts: int = LEAST_BLOCKS
    hot: int = 20_000


def runs(x: Callable[[int, int], np.ndarray], offsets: np.ndarray, width: int, gram: int):
    """First window, number of windows and minimizer hash of every segment of the rows."""
    total, span = int(offsets[-1]), width - gram + 1
    lengths = np.diff(offsets)
    edge = np.zeros(total + 1, np.int8)
    edge[offsets[:-1][lengths >= width]] += 1
    edge[offsets[1:][lengths >= width] - width + 1] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    found = []
    for a in range(0, total, CHUNK):
        at = np.flatnonzero(inside[a : a + CHUNK])
        if not len(at):
            continue
        tokens = x(a, min(total, a + CHUNK + width - 1))
        h = gram_hashes(tokens, gram)
        places = np.arange(len(h), dtype=np.uint64)
        least = sliding_min((h >> POSITION_BITS << POSITION_BITS) | places, span)
        place = (least & np.uint64((1 << int(POSITION_BITS)) - 1)).astype(np.int64)[at]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(place) != 0)
        first = np.flatnonzero(new)
        found.append((at[first] + a, np.diff(np.append(first, len(at))), h[place[first]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def filter_keys(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of a minimizer in the upper half, 32 bits of its hash in the lower."""
    return ((h >> np.uint64(40)) % np.uint64(parts) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def send_grams(plan: Plan, table: pa.Table) -> pa.Table:
    data, offsets, _, _ = in_order(table)
    x, offsets, _ = plan.codes(data, offsets)
    _, _, h = runs(x, offsets, plan.width, plan.gram)
    keys, counts = np.unique(filter_keys(h, plan.parts), return_counts=True)
    cuts = np.searchsorted(keys, np.arange(plan.parts + 1, dtype=np.uint64) << np.uint64(32))
    block = table["block"][0].as_py()
    rows = [
        (p, block, keys[a:b].astype(np.uint32).tobytes(), pack(np.minimum(counts[a:b], 65535).astype(np.uint16)))
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
        if b > a
    ]
    return pa.table(list(map(list, zip(*rows, strict=True))) or [[]] * 4, schema=schema(GRAMS))


def answer_grams(plan: Plan, table: pa.Table) -> pa.Table:
    """Two bits for every minimizer sent: met more than once in the corpus, and hot."""
    blobs = [np.frombuffer(b, np.uint32) for b in table["hashes"].to_pylist()]
    counts = np.concatenate([unpack(b, np.uint16) for b in table["counts"].to_pylist()])
    _, place = np.unique(np.concatenate(blobs), return_inverse=True)
    total = np.bincount(place, weights=counts)[place]
    cuts = np.cumsum([0, *map(len, blobs)])
    bits = [
        pack(np.packbits(np.concatenate([total[a:b] > 1, total[a:b] >= plan.hot])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True)
    ]
    n = len(bits)
    return pa.table([table["block"].combine_chunks(), [0] * n, table["part"].combine_chunks(), bits], schema=schema(ANSWERS))


def repeated_runs(plan: Plan, x, offsets: np.ndarray, answers: pa.Table):
    """The segments of minimizers met more than once: first window, number, shard and identity."""
    start, n, h = runs(x, offsets, plan.width, plan.gram)
    keys, place = np.unique(filter_keys(h, plan.parts), return_inverse=True)
    cuts = np.searchsorted(keys, np.arange(plan.parts + 1, dtype=np.uint64) << np.uint64(32))
    more, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for step, part, bits in zip(answers["step"].to_pylist(), answers["part"].to_pylist(), answers["bits"].to_pylist(), strict=True):
        if step == 0:
            a, b = cuts[part], cuts[part + 1]
            both = np.unpackbits(unpack(bits, np.uint8))[: 2 * (b - a)].astype(bool)
            more[a:b], hot[a:b] = both[: b - a], both[b - a :]
    more, hot = more[place], hot[place]
    single = more & hot
    if single.any():  # one segment for each window
        start, n = np.concatenate([start[more & ~hot], spread(start[single], n[single])]), np.concatenate([n[more & ~hot], np.ones(n[single].sum(), np.int64)])
        h = np.concatenate([h[more & ~hot], np.zeros(len(start) - (more & ~hot).sum(), np.uint64)])
        order = np.argsort(start, kind="stable")
        start, n, h = start[order], n[order], h[order]
    else:
        start, n, h = start[more], n[more], h[more]
    first, last = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    for a in range(0, int(offsets[-1]), CHUNK):
        i, j = np.searchsorted(start, [a, a + CHUNK])
        if j > i:
            tokens = x(a, min(int(offsets[-1]), a + CHUNK + 2 * plan.width))
            first[i:j] = window_hashes(tokens, start[i:j] - a, plan.width)
            last[i:j] = window_hashes(tokens, start[i:j] - a + n[i:j] - 1, plan.width)
    # The first and the last window cover the segment.
    prints = mix(first * np.uint64(0x9E3779B97F4A7C15) + last + n.astype(np.uint64))
    shard = (mix(np.where(h == 0, first, h) + np.uint64(1)) % np.uint64(plan.parts)).astype(np.int64)
    return start, n, shard, prints


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every run of n windows, in turn."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - n), n)


def send_segments(plan: Plan, table: pa.Table, answers: pa.Table) -> pa.Table:
    out = []
    if table.num_rows:
        data, rows, ids, _ = in_order(table)
        x, offsets, _ = plan.codes(data, rows)
        start, n, shard, prints = repeated_runs(plan, x, offsets, answers)
        _, first = np.unique(prints, return_index=True)
        first = first[np.lexsort([first, shard[first]])]
        block = table["block"][0].as_py()
        documents = ids[np.searchsorted(offsets, start[first], side="right") - 1]
        cuts = np.searchsorted(shard[first], np.arange(plan.parts + 1))
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                f = first[a:b]
                tokens = plan.codes.take(data, x, spread(start[f], n[f] + plan.width - 1))
                words, tokens = np.unique(tokens, return_inverse=True) if tokens.dtype == np.uint64 else (np.empty(0, np.uint64), tokens)
                if len(words):
                    tokens = tokens.astype(np.uint16 if len(words) < 65536 else np.uint32)
                out.append((p, block, pack(n[f].astype(np.uint8)), prints[f].tobytes(), pack(documents[a:b]), pack(start[f]), words.tobytes(), bytes([tokens.itemsize]) + pack(tokens)))
    return pa.table(list(map(list, zip(*out, strict=True))) or [[]] * 8, schema=schema(SEGMENTS))


def answer_segments(plan: Plan, table: pa.Table) -> pa.Table:
    """One bit for every window sent: whether an earlier copy of it exists."""
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32}
    read = lambda name, kind: [unpack(b, kind) for b in table[name].to_pylist()]
    n_of = read("n", np.uint8)
    n = np.concatenate(n_of).astype(np.int64)
    prints = np.concatenate([np.frombuffer(b, np.uint64) for b in table["prints"].to_pylist()])
    ids, starts = np.concatenate(read("ids", np.int64)), np.concatenate(read("starts", np.int64))
    tokens = []
    for words, blob in zip(table["words"].to_pylist(), table["tokens"].to_pylist(), strict=True):
        t = unpack(blob[1:], kinds[blob[0]])
        tokens.append(np.frombuffer(words, np.uint64)[t] if len(words) else t)
    tokens = np.concatenate(tokens)
    # Equal segments of several blocks are looked up once, at their earliest place.
    order = np.lexsort([starts, ids, prints])
    new = np.ones(len(order), bool)
    new[1:] = np.diff(prints[order]) != 0
    earliest = order[new]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    bounds = np.concatenate([[0], np.cumsum(n + plan.width - 1)])
    kept = tokens[spread(bounds[earliest], n[earliest] + plan.width - 1)]
    found = plan.engine(Segments(n[earliest], kept, ids[earliest], starts[earliest], plan.width))
    at = np.concatenate([[0], np.cumsum(n[earliest])])
    # A block has all rows of an id, so a segment of another block is later as a whole.
    later = earliest[group] != np.arange(len(group))
    answers = np.where(np.repeat(later, n), True, found[spread(at[group], n)])
    cuts = np.concatenate([[0], np.cumsum([int(c.sum()) for c in n_of])])
    bits = [pack(np.packbits(answers[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    k = len(bits)
    return pa.table([table["block"].combine_chunks(), [1] * k, table["part"].combine_chunks(), bits], schema=schema(ANSWERS))


def apply_answers(plan: Plan, table: pa.Table, answers: pa.Table) -> pa.Table:
    if not table.num_rows:
        return plan.finish.empty()
    data, rows, ids, given = in_order(table)
    x, offsets, extra = plan.codes(data, rows)
    start, n, shard, prints = repeated_runs(plan, x, offsets, answers)
    repeated = np.zeros(int(offsets[-1]), bool)
    if len(start):
        _, first, group = np.unique(prints, return_index=True, return_inverse=True)
        order = np.lexsort([first, shard[first]])
        cuts = np.searchsorted(shard[first[order]], np.arange(plan.parts + 1))
        sent = n[first[order]]
        at = np.concatenate([[0], np.cumsum(sent)])
        bits = np.zeros(at[-1], bool)
        for step, part, blob in zip(answers["step"].to_pylist(), answers["part"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            if step == 1:
                a, b = at[cuts[part]], at[cuts[part + 1]]
                bits[a:b] = np.unpackbits(unpack(blob, np.uint8))[: b - a]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        document = ids[np.searchsorted(offsets, start, side="right") - 1]
        copy = first[group]
        later = (copy != np.arange(len(start))) if plan.same_document else (document[copy] != document)
        hit = np.where(np.repeat(later, n), True, bits[spread(at[place[group]], n)])
        repeated[spread(start, n)[hit]] = True
    sums = np.concatenate([[0], np.cumsum(repeated)])
    ends = np.arange(1, len(repeated) + 1)
    covered = sums[ends] > sums[np.maximum(ends - plan.width, 0)]
    return plan.finish(given, data, rows, offsets, covered, extra)


def search(docs: DataFrame, plan: Plan, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Runs the plan over all rows of (doc_id, text). One row for every row of ``docs``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(LEAST_BLOCKS, math.ceil(size / block_bytes))
    plan = Plan(**{**plan.__dict__, "parts": max(plan.parts, n_blocks)})
    block = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(n_blocks)).cast("int")
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), block.alias("block"))
    by_block = lambda: blocks.groupBy("block")
    grams = by_block().applyInArrow(lambda t: send_grams(plan, t), GRAMS)
    more = grams.groupBy("part").applyInArrow(lambda t: answer_grams(plan, t), ANSWERS)
    segments = by_block().cogroup(more.groupBy("block")).applyInArrow(lambda t, m: send_segments(plan, t, m), SEGMENTS)
    earlier = segments.groupBy("part").applyInArrow(lambda t: answer_segments(plan, t), ANSWERS)
    answers = more.unionByName(earlier).groupBy("block")
    return by_block().cogroup(answers).applyInArrow(lambda t, m: apply_answers(plan, t, m), plan.output)
