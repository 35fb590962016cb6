"""Shards of near equal bytes by histogram sort."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import packed, whole, written
from trailmark.operators.ordering import running

KEY_BITS = 62
SLOT_BITS = 12


def unsigned62(hashed: Column) -> Column:
    """A non-negative number of 62 bits, so that differences of two never overflow."""
    return F.shiftrightunsigned(hashed, 2)


@dataclass
class Boundary:
    """Search state of one splitter: it lies in [low, high) of ``part``, with ``below`` bytes before low."""

    target: float
    low: int = 0
    high: int = 1 << KEY_BITS
    below: int = 0
    group: int | None = None  # the text key, once the search goes on among its ids
    found: tuple[int, int] | None = None


def splitters(keyed: DataFrame, shards: int, tolerance: float, probes: int = 64) -> list[tuple[int, int]]:
    """``shards - 1`` keys (text_key, id_key) that cut the rows into shards of near equal bytes.

    Every round counts the exact bytes between the probes of all boundaries in one aggregation, whose
    result has at most (shards - 1) * probes rows, and goes on inside the gap that holds the target.
    A boundary is found when a probe is within ``tolerance`` of a shard's share. A text key heavier
    than that is searched on by the keys of its ids, so a group of copies of any size can be cut.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    bounds = [Boundary(target=total * i / shards) for i in range(1, shards)]
    while pending := [b for b in bounds if b.found is None]:
        spaces = sorted({(b.group, b.low, b.high, b.below) for b in pending}, key=str)
        cases = []
        for group, low, high, _ in spaces:
            key = F.col("text_key") if group is None else F.col("id_key")
            step = max(1, math.ceil((high - low) / probes))
            inside = (key >= low) & (key < high)
            if group is not None:
                inside &= F.col("text_key") == group
            cases.append((inside, F.floor((key - F.lit(low)) / F.lit(step)) if step == 1 else F.expr(f"({'text_key' if group is None else 'id_key'} - {low}L) div {step}L")))
        counts: dict[tuple[int, int], int] = {}
        found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("space"), g.cast("long").alias("gap"))) for i, (c, g) in enumerate(cases)]))
        gaps = keyed.select("size", F.explode(found).alias("at")).groupBy("at.space", "at.gap").agg(F.sum("size").alias("bytes"))
        for space, gap, size in gaps.collect():
            counts[space, gap] = size
        for b in pending:
            at = spaces.index((b.group, b.low, b.high, b.below))
            step = max(1, math.ceil((b.high - b.low) / probes))
            below, edges = b.below, []
            for gap in range(math.ceil((b.high - b.low) / step)):
                edges.append((b.low + gap * step, below, counts.get((at, gap), 0)))
                below += counts.get((at, gap), 0)
            edges.append((b.high, below, 0))
            near = min(edges, key=lambda e: abs(e[1] - b.target))
            if abs(near[1] - b.target) <= slack:
                b.found = (near[0], 0) if b.group is None else (b.group, near[0])
                continue
            start, before, held = next(e for e in edges if e[1] <= b.target <= e[1] + e[2])
            if step > 1:
                b.low, b.high, b.below = start, min(start + step, b.high), before
            elif b.group is None:
                b.group, b.low, b.high, b.below = start, 0, 1 << KEY_BITS, before
            else:  # one id is heavier than the tolerance: it goes to the nearer side
                b.found = (b.group, start if b.target - before < before + held - b.target else start + 1)
    return [b.found for b in bounds]


def shard_of(cuts: list[tuple[int, int]]) -> Column:
    """Number of cuts at or below a row's key, as a binary decision tree."""

    def tree(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        text_key, id_key = cuts[middle]
        before = (F.col("text_key") < text_key) | ((F.col("text_key") == text_key) & (F.col("id_key") < id_key))
        return F.when(before, tree(first, middle)).otherwise(tree(middle + 1, last))

    return tree(0, len(cuts))


def with_keys(docs: DataFrame) -> DataFrame:
    """Each row packed, with size, text_crc32 and the sort key; equal texts have equal text keys."""
    raw = whole("text")
    return packed(
        docs,
        size=F.octet_length(raw).cast("long") + 1,
        text_crc32=F.crc32(raw.cast("binary")),
        text_key=unsigned62(F.xxhash64(raw)),
        id_key=unsigned62(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))),
    )


def sharded(docs: DataFrame, shards: int = 16, tolerance: float = 0.01) -> DataFrame:
    """Every row of ``docs`` with its size, text_crc32, shard and slot; rows keep all their columns.

    Rows are ordered by hashes of text and id. Splitters come from counts over a narrow table of keys
    and sizes; then the rows move once, to the place of their shard and slot range. Slots count from
    0 in each shard, by id hash. A null text is empty and has size 1. Rows with equal text and id
    have the same key, so they share a shard; everything else can be cut anywhere. Columns named
    like the added ones are replaced. An empty table gives an empty result.
    """
    keyed = with_keys(docs)
    narrow = written(keyed.select("text_key", "id_key", "size"), "shard-keys")
    cuts = splitters(narrow, shards, tolerance) if not narrow.isEmpty() else [(0, 0)] * (shards - 1)
    placed = keyed.withColumn("shard", shard_of(cuts).cast("int"))
    placed = placed.withColumn("range", F.shiftright("id_key", KEY_BITS - SLOT_BITS))
    order = [F.col("id_key"), F.col("text_key"), F.col("text_crc32"), F.col("size")]
    ranked = running(placed, ["shard"], "range", order, {"place": F.lit(1)})
    ranked = ranked.withColumn("slot", F.col("place").cast("long") - 1)
    added = ("size", "text_crc32", "shard", "slot")
    return ranked.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added], *added)
