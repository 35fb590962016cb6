"""Documents with similar sets of word n-grams, joined through prefix trees."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import attach, packed, written
from trailmark.llm.components import connected
from trailmark.llm.prefix_tree import links
from trailmark.llm.tokens import LAST_ID, LOWER, gram_hashes, in_order, mix, pack, unpack, window_hashes, word_bounds, word_hashes
from trailmark.llm.windows import BLOCK_BYTES, LEAST_BLOCKS, filter_keys, schema

GRAMS = "part int, block int, hashes binary, counts binary"
COUNTS = "block int, part int, counts binary"
SETS = "doc_id long, n_shingles long, print binary, elements array<long>, parity binary"
ARROW_SETS = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print", pa.binary()), ("elements", pa.list_(pa.int64())), ("parity", pa.binary())]
)
CHUNK = 250
MOST_COUNTED = 127
LEADERS = 16
# Sets with a common head that are joined as pairs; bits of the smallest parity map.
SMALL, LEAST_BITS = 64, 512
MEMBERS = "node long, hub long"


def shingle_sets(table: pa.Table, words: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row number and hash of every distinct shingle, by row; and the ids of the rows in order."""
    data, rows, _, given = in_order(table)
    starts, ends, offsets = word_bounds(data, rows)
    hashes = word_hashes(LOWER[data], starts, ends)
    lengths = np.diff(offsets)
    row, shingle = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    if len(hashes) >= words:
        of = np.repeat(np.arange(len(lengths)), lengths)
        full = np.arange(len(hashes) - words + 1) + words <= offsets[of[: len(hashes) - words + 1] + 1]
        shingle.append(gram_hashes(hashes, words)[full])
        row.append(of[: len(full)][full])
    for short in range(1, words):  # the whole sequence is the one shingle
        at = np.flatnonzero(lengths == short)
        shingle.append(mix(window_hashes(hashes, offsets[at], short) + np.uint64(short)))
        row.append(at)
    row, shingle = np.concatenate(row), np.concatenate(shingle)
    order = np.argsort(row, kind="stable")
    row, shingle = row[order], shingle[order]
    cuts = np.searchsorted(row, np.arange(len(lengths) + 1)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        shingle[a:b].sort()
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (shingle[1:] != shingle[:-1])
    return row[new], shingle[new], given


def send_shingles(words: int, parts: int, table: pa.Table) -> pa.Table:
    _, shingle, _ = shingle_sets(table, words)
    keys, counts = np.unique(filter_keys(shingle, parts), return_counts=True)
    cuts = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
    block = table["block"][0].as_py()
    out = [
        (p, block, keys[a:b].astype(np.uint32).tobytes(), pack(counts[a:b].astype(np.uint32)))
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
        if b > a
    ]
    return pa.table(list(map(list, zip(*out, strict=True))) or [[]] * 4, schema=schema(GRAMS))


def count_shingles(table: pa.Table) -> pa.Table:
    """For every shingle sent, the number of documents that have it, up to MOST_COUNTED."""
    blobs = [np.frombuffer(b, np.uint32) for b in table["hashes"].to_pylist()]
    counts = np.concatenate([unpack(b, np.uint32) for b in table["counts"].to_pylist()])
    _, place = np.unique(np.concatenate(blobs), return_inverse=True)
    total = np.minimum(np.bincount(place, weights=counts), MOST_COUNTED).astype(np.uint8)[place]
    cuts = np.cumsum([0, *map(len, blobs)])
    sent = [pack(total[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table([table["block"].combine_chunks(), table["part"].combine_chunks(), sent], schema=schema(COUNTS))


def send_sets(words: int, parts: int, enough: tuple[int, int], table: pa.Table, counts: pa.Table) -> pa.Table:
    """A row per document. One that shares enough shingles to have a partner has a print of its set, and
    the first document of a block with that print has the shared shingles: their counts in the upper
    byte, their hashes below, ascending, which is the global order from rare to frequent; and their parity map."""
    if not table.num_rows:
        return ARROW_SETS.empty_table()
    row, shingle, given = shingle_sets(table, words)
    keys, place = np.unique(filter_keys(shingle, parts), return_inverse=True)
    cuts = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
    often = np.ones(len(keys), np.uint64)
    for part, blob in zip(counts["part"].to_pylist(), counts["counts"].to_pylist(), strict=True):
        a, b = cuts[part], cuts[part + 1]
        often[a:b] = unpack(blob, np.uint8)
    often = often[place]
    shared = often > 1
    ordered = (often << np.uint64(56)) | (shingle >> np.uint64(8))
    n = np.bincount(row, minlength=len(given))
    n_shared = np.bincount(row[shared], minlength=len(given))
    near = (n > 0) & (enough[1] * n_shared >= enough[0] * n)
    at = np.concatenate([[0], np.cumsum(n)])
    prints, elements, maps, seen = [], [], [], set()
    for i in range(len(given)):
        if not near[i]:
            prints.append(None)
            elements.append(None)
            maps.append(None)
            continue
        own = shingle[at[i] : at[i + 1]]
        key = b"".join(int(v).to_bytes(8, "little") for v in (len(own), mix(own).sum(dtype=np.uint64), mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))
        prints.append(key)
        held = None if key in seen else np.sort(ordered[at[i] : at[i + 1]][shared[at[i] : at[i + 1]]])
        elements.append(None if held is None else held.view(np.int64))
        maps.append(None if held is None else parity_map(held, len(own)))
        seen.add(key)
    columns = [given, n, pa.array(prints, pa.binary()), pa.array(elements, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
    return pa.table(columns, schema=ARROW_SETS)


def parity_map(elements: np.ndarray, n: int) -> bytes:
    """A bit for every hash: whether an odd number of elements has it. There are at least as many bits as shingles, a power of two."""
    bits = max(LEAST_BITS, 1 << (n - 1).bit_length())
    places = (mix(elements) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits).astype(np.uint8) & 1).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Elements that only one of two sets has, at least, from their parity maps; the larger map is folded to the smaller."""
    size = 8 * min(len(x), len(y))
    ends = []
    for bits in (x, y):
        value, held = int.from_bytes(bits), 8 * len(bits)
        while held > size:
            held //= 2
            value = (value >> held) ^ (value & ((1 << held) - 1))
        ends.append(value)
    return (ends[0] ^ ends[1]).bit_count()


def sets_of(docs: DataFrame, words: int, enough: tuple[int, int], block_bytes: int) -> DataFrame:
    """doc_id, n_shingles, print and elements of every row; the last two only where a partner can exist.

    Which shingles two documents share is counted over the whole corpus; a block sends four bytes for
    each of its distinct shingles and gets one byte back. A document whose own shingles are too many has no
    partner; it goes no further.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(LEAST_BLOCKS, math.ceil(size / block_bytes))
    parts = max(LEAST_BLOCKS, n_blocks // 6)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), F.xxhash64("text"))
    block = F.pmod(key, F.lit(n_blocks)).cast("int")
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), block.alias("block"))
    sent = blocks.groupBy("block").applyInArrow(lambda t: send_shingles(words, parts, t), GRAMS)
    counts = sent.groupBy("part").applyInArrow(count_shingles, COUNTS)
    return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        lambda t, c: send_sets(words, parts, enough, t, c), SETS
    )


def least_overlap(size: Column, enough: tuple[int, int]) -> Column:
    """Elements that a set of this size shares with any partner, at least."""
    return F.ceil(size * F.lit(enough[0]) / F.lit(enough[1])).cast("long")


def join_chunk(enough: tuple[int, int], table: pa.Table) -> pa.Table:
    """(node, hub) of the sets of one chunk: a set and the first set of its component.

    Of two visitors none belongs here: they meet elsewhere.
    """
    nodes, sizes, labels = (table[c].to_numpy() for c in ("node", "n", "known"))
    home = table["home"].to_pylist()
    lists = table["elements"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    _, rank = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    sets = [rank[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    joined = links(sets, sizes, enough, labels.tolist(), lambda i, j: home[i] or home[j])
    hubs = [nodes[joined.find(i)] for i in range(len(nodes))]
    return pa.table({"node": pa.array(nodes, pa.int64()), "hub": pa.array(hubs, pa.int64())})


def in_chunks(rows: DataFrame, enough: tuple[int, int]) -> DataFrame:
    return rows.groupBy("group", "chunk").applyInArrow(lambda t: join_chunk(enough, t), "node long, hub long")


def may_link(x: dict[str, Any], y: dict[str, Any], enough: tuple[int, int]) -> Any:
    """Whether sets of ``n`` shingles that first meet at an element with ``rest`` elements after it can be linked; of
    numbers, arrays or columns."""
    num, den = enough
    least = F.least if isinstance(x["rest"], Column) else np.minimum
    total = x["n"] + y["n"]
    return (den * x["n"] >= num * y["n"]) & (den * y["n"] >= num * x["n"]) & ((num + den) * (1 + least(x["rest"], y["rest"])) >= num * total)


def near_enough(differ: Any, total: Any, enough: tuple[int, int]) -> Any:
    """Whether sets of ``total`` shingles together may be linked if ``differ`` elements or more are in one of them only."""
    num, den = enough
    return (num + den) * differ <= (den - num) * total


def alike(enough: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, hub) of the pairs whose parity maps allow a link: the later set of a pair and the earlier in the hub of that one."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart, total = (batch[c].to_numpy() for c in ("apart", "total"))
            differ = [differing(x, y) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)]
            ok = near_enough(apart + np.array(differ, np.int64), total, enough)
            first, second = (batch[c].to_numpy()[ok] for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([first, second])), pa.array(np.concatenate([first, first]))], names=["node", "hub"])

    return keep


def forest(enough: tuple[int, int], table: pa.Table) -> pa.Table:
    """(node, hub) that connect the sets of one head, or a chunk of them, as far as lengths, places and parity maps allow links.

    Sets of one ``known`` label are connected already. Of two visitors none belongs here: they meet elsewhere.
    """
    table = table.sort_by([("n", "ascending"), ("node", "ascending")])
    node, n, m, rest, known = (table[c].to_numpy().astype(np.int64) for c in ("node", "n", "m", "rest", "known"))
    home, maps = table["home"].to_numpy(), table["parity"].to_pylist()
    _, label = np.unique(known, return_inverse=True)
    nodes, hubs = [], []
    for i in range(len(node) - 1):
        j = slice(i + 1, int(np.searchsorted(n, enough[1] * n[i] // enough[0], side="right")))
        open_ = (label[j] != label[i]) & (home[j] | home[i]) & may_link({"n": n[i], "rest": rest[i]}, {"n": n[j], "rest": rest[j]}, enough)
        for other in (np.flatnonzero(open_) + i + 1).tolist():
            if label[other] == label[i]:
                continue
            differ = n[i] - m[i] + n[other] - m[other] + differing(maps[i], maps[other])
            if near_enough(differ, n[i] + n[other], enough):
                label[label == label[other]] = label[i]
                nodes += [node[i], node[other]]
                hubs += [node[i], node[i]]
    return pa.table({"node": pa.array(nodes, pa.int64()), "hub": pa.array(hubs, pa.int64())})


def candidates(classes: DataFrame, enough: tuple[int, int], chunk: int) -> DataFrame:
    """node, hub of the distinct sets (node, n, elements, parity), such that sets that are linked are connected through hubs.

    Two sets that overlap enough have their first common element among the first n - least + 1 elements, the heads, of both. Sets
    with a common head are compared by their lengths, by the elements that are left after it, and by their parity maps: few that
    are not similar pass all three, so neither chance nor a frequent passage connects the corpus. Up to ``SMALL`` sets
    of a head meet as pairs. More, ``4 * chunk`` at most, meet in one task, and more than that are dealt
    into chunks that a few leading sets visit; those still apart from the main component of the head then visit every chunk.
    """
    small, most = min(SMALL, chunk), 4 * chunk
    size = F.size("elements")
    first = (size - least_overlap(F.col("n"), enough) + 1).cast("int")
    heads = classes.select("node", "n", size.alias("m"), F.posexplode(F.slice("elements", 1, first)).alias("pos", "head"))
    heads = heads.select("head", "node", "n", "m", (F.col("m") - F.col("pos") - 1).alias("rest"))
    # An element is in no more sets than its count says.
    often = F.shiftright("head", 56) > small
    sizes = heads.where(often).groupBy("head").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > small)
    sizes = written(sizes.withColumn("w", F.col("size")), "head-sizes")
    in_sizes = sizes.agg(F.sum("w")).first()[0] or 0
    if not in_sizes:
        return written(paired(heads, classes, enough), "candidates")
    sized = attach(heads.where(often), sizes, "head", "w", in_sizes, F.col("node"))
    rare = heads.where(~often).unionByName(sized.where(F.col("size").isNull()).drop("size"))
    dealt = sized.where(F.col("size").isNotNull()).join(classes.select("node", "parity"), "node")
    dealt = dealt.withColumn("chunks", F.ceil(F.col("size") / F.lit(most)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # The leaders of all heads of similar sets are mostly the same ones.
    leads = (F.col("chunks") > 1) & (F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 31)) * F.col("size") < F.lit(LEADERS << 31))
    everywhere = F.sequence(F.lit(0), F.col("chunks") - 1)

    def met(rows: DataFrame) -> DataFrame:
        homed = rows.withColumn("home", F.col("chunk") == F.col("own"))
        return homed.groupBy("head", "chunk").applyInArrow(lambda t: forest(enough, t), MEMBERS)

    visit = dealt.withColumn("chunk", F.explode(F.when(leads, everywhere).otherwise(F.array("own")))).withColumn("known", F.col("node"))
    found = written(paired(rare, classes, enough).unionByName(met(visit)), "candidates")
    if sizes.where(F.col("size") > most).isEmpty():
        return found
    labels = connected(found).withColumnRenamed("label", "known")
    large = dealt.where(F.col("chunks") > 1).join(labels, "node", "left").withColumn("known", F.coalesce("known", "node"))
    parts = large.groupBy("head", "known").agg(F.count(F.lit(1)).alias("n_in"))
    main = parts.groupBy("head").agg(F.max(F.struct("n_in", "known"))["known"].alias("main"), F.sum("n_in").alias("w"), F.count(F.lit(1)).alias("parts"))
    main = written(main, "main-components")
    kept = attach(large, main, "head", "w", main.agg(F.sum("w")).first()[0] or 0, F.col("node")).where(F.col("parts") > 1)
    at = F.when(F.col("known") == F.col("main"), F.array("own")).otherwise(everywhere)
    return found.unionByName(written(met(kept.withColumn("chunk", F.explode(at))), "candidates"))


def paired(heads: DataFrame, classes: DataFrame, enough: tuple[int, int]) -> DataFrame:
    """node, hub of the pairs of sets with a common head, in which the earlier set is the hub, that may be linked."""
    ends = [heads.select("head", F.struct("node", "n", "rest").alias(c)) for c in ("x", "y")]
    x, y = ({c: F.col(f"{end}.{c}") for c in ("node", "n", "rest")} for end in ("x", "y"))
    pairs = ends[0].join(ends[1], "head").where((x["node"] < y["node"]) & may_link(x, y, enough))
    pairs = pairs.select(x["node"].alias("a"), y["node"].alias("b")).distinct()
    for end, other in (("a", "x"), ("b", "y")):
        unshared = (F.col("n") - F.size("elements")).alias(f"apart_{other}")
        pairs = pairs.join(classes.select(F.col("node").alias(end), F.col("n").alias(f"n_{other}"), unshared, F.col("parity").alias(other)), end)
    asked = pairs.select("a", "b", "x", "y", (F.col("apart_x") + F.col("apart_y")).alias("apart"), (F.col("n_x") + F.col("n_y")).alias("total"))
    return asked.mapInArrow(alike(enough), MEMBERS)


def linked_sets(classes: DataFrame, enough: tuple[int, int], chunk: int) -> DataFrame:
    """node, label of the distinct sets (node, n, elements) that are linked to others.

    Elements are in the global order from rare to frequent; those of one document only come first and
    are left out. Sets connected as candidates are a group and meet in one task. A group of more than ``chunk`` sets is dealt into chunks that a few
    leading sets visit; those which are then still apart from the group's main component visit every
    chunk. So each pair of sets not yet connected meets in one place, and no task grows with a group.
    """
    groups = connected(candidates(classes, enough, chunk)).withColumnRenamed("label", "group")
    sizes = written(groups.groupBy("group").agg(F.count(F.lit(1)).alias("size")).withColumn("w", F.col("size")), "group-sizes")
    sized = attach(groups, sizes, "group", "w", groups.count(), F.col("node")).where(F.col("size") > 1)
    n_chunks = F.ceil(F.col("size") / F.lit(chunk)).cast("int")
    dealt = classes.drop("parity").join(sized, "node").withColumn("chunks", n_chunks)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = written(dealt, "dealt-sets")
    leads = (F.col("chunks") > 1) & ((F.col("node") == F.col("group")) | (F.pmod(F.xxhash64(F.lit(3), "node"), F.col("size")) < LEADERS))
    everywhere = F.sequence(F.lit(0), F.col("chunks") - 1)
    visit = dealt.withColumn("chunk", F.explode(F.when(leads, everywhere).otherwise(F.array("own"))))
    visit = visit.withColumn("home", F.col("chunk") == F.col("own")).withColumn("known", F.col("node"))
    stars = written(in_chunks(visit, enough), "links")
    large = dealt.where(F.col("chunks") > 1)
    if large.isEmpty():
        return connected(stars)
    labels = connected(stars)
    placed = large.join(labels.select("node", F.col("label").alias("known")), "node")
    parts = placed.groupBy("group", "known").agg(F.count(F.lit(1)).alias("n_in"))
    main = parts.groupBy("group").agg(F.max(F.struct("n_in", "known"))["known"].alias("main"), F.sum("n_in").alias("w"))
    main = written(main, "main-components")
    kept = attach(placed, main, "group", "w", main.agg(F.sum("w")).first()[0] or 0, F.col("node"))
    apart = kept.where(F.col("known") != F.col("main")).withColumn("chunk", F.explode(everywhere))
    here = kept.where(F.col("known") == F.col("main")).withColumn("chunk", F.col("own"))
    again = here.unionByName(apart).withColumn("home", F.col("chunk") == F.col("own"))
    return connected(stars.unionByName(in_chunks(again, enough)))


def similar_documents(
    docs: DataFrame, words: int = 5, enough: tuple[int, int] = (4, 5), chunk: int = CHUNK, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of (doc_id, text).

    Two documents are linked when den * |x & y| >= num * |x | y| for their sets of distinct ``words``-word
    shingles, with (num, den) = ``enough``; A-Z are lower-cased. component_id is the smallest doc_id
    reachable by links, the document's own included. A document with fewer words has one shingle; one
    without words or text has none and is linked with nothing. Equal sets are one class, joined once. Rows
    of one id are one document in the links; a null id is the largest, and null in the result.
    """
    sets = written(sets_of(docs, words, enough, block_bytes), "shingle-sets")
    near = sets.where(F.col("print").isNotNull())
    node = F.coalesce("doc_id", F.lit(LAST_ID))
    classes = written(
        near.groupBy("print").agg(
            F.min(node).alias("node"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("w"),
            F.first("elements", ignorenulls=True).alias("elements"), F.first("parity", ignorenulls=True).alias("parity"),
        ),
        "set-classes",
    )
    found = linked_sets(classes.select("node", "n", "elements", "parity"), enough, chunk)
    labelled = classes.select("print", "node", "w").join(found, "node", "left")
    lookup = written(labelled.select("print", "w", F.coalesce("label", "node").alias("label")), "set-labels")
    total = lookup.agg(F.sum("w")).first()[0] or 0
    met = attach(near.select("doc_id", "n_shingles", "print"), lookup, "print", "w", total, F.col("doc_id"))
    component = F.when(F.col("label") != LAST_ID, F.col("label"))
    rest = sets.where(F.col("print").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return met.select("doc_id", "n_shingles", component.alias("component_id")).unionByName(rest)


def drop_similar(docs: DataFrame, **options: Any) -> DataFrame:
    """The rows whose id is the smallest of its component, with all their columns; all rows without an id."""
    kept = similar_documents(docs, **options).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = kept.select(F.struct("doc_id").alias("id")).distinct()
    keyed = packed(docs, id=F.struct(F.col("doc_id").cast("long").alias("doc_id")))
    return keyed.join(ids, "id", "left_semi").select("row.*")
