"""Blocks of whole texts, and the answers of sharded tables to what is distinct in a block."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import written

HELD = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.large_string()), ("train", pa.bool_()), ("text", pa.large_string())])
BLOCK_CHARS, BLOCK_DOCS = 16 << 20, 1 << 16
# Parts of a sharded lookup: PARTS at least, and one for each BLOCKS_PER_PART blocks, so that a part does not grow.
PARTS, BLOCKS_PER_PART = 64, 8
ASKED = "block long, part int, held binary"


def _block(number: int, rows: pa.Table) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))
    with pa.ipc.new_stream(sink, HELD, options=options) as out:
        out.write_table(rows)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "held"])


def rows_of(held: bytes) -> pa.Table:
    with pa.ipc.open_stream(held) as found:
        return found.read_all()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one task as blocks. A block's number is a digest of its place and keys, so that other rows in its place are another block."""
    context = TaskContext.get()
    place = (context.partitionId() if context else 0) << 32
    held, n, size = [], 0, 0

    def block() -> tuple[int, pa.Table]:
        rows = pa.concat_tables(held).combine_chunks()
        digest = hashlib.blake2b(place.to_bytes(8, "little") + rows["key"].to_numpy().tobytes(), digest_size=8).digest()
        return int.from_bytes(digest, "little", signed=True), rows

    for batch in batches:
        rows, first = pa.Table.from_batches([batch]).select(HELD.names).cast(HELD), 0
        for i, length in enumerate(pc.fill_null(pc.utf8_length(rows["text"]), 0).to_pylist(), 1):
            n, size = n + 1, size + length
            if size >= BLOCK_CHARS or n == BLOCK_DOCS:
                held.append(rows.slice(first, i - first))
                yield block()
                held, n, size, first, place = [], 0, 0, i, place + 1
        held.append(rows.slice(first))
    if n:
        yield block()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, rows in _cut(batches):
        yield _block(number, rows)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    for batch in batches:
        for number, held in zip(batch["block"].to_pylist(), batch["held"], strict=True):
            yield number, rows_of(held.as_py())


@dataclass(frozen=True)
class Blocks:
    """(key, doc_id, lang, train, text) rows as blocks of about BLOCK_CHARS characters: (block, held) rows, compressed.

    ``kept`` says that they are a table. Without it they are made from ``rows`` whenever they are read, which saves the disk of a copy
    of all texts but needs rows that come alike each time, as those of a scan of files do; others are an error.
    """

    rows: DataFrame
    table: DataFrame
    kept: bool
    parts: int

    def read(self, do: Callable[[Iterator[tuple[int, pa.Table]]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
        """What ``do`` makes of the blocks, each with its number."""
        source, cut = (self.table, _held) if self.kept else (self.rows, _cut)
        return source.mapInArrow(lambda batches: do(cut(batches)), ddl)


def text_blocks(rows: DataFrame, keep: bool = True) -> Blocks:
    rows = rows.select(*HELD.names)
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    table = rows.mapInArrow(_blocks, "block long, held binary")
    return Blocks(rows, written(table, "text-blocks") if keep else table, keep, max(PARTS, chars // (BLOCK_CHARS * BLOCKS_PER_PART)))


def pack(*arrays: np.ndarray) -> bytes:
    """Equally long arrays of 8-byte numbers, compressed plane by plane of their bytes."""
    planes = np.concatenate([a.view(np.uint8).reshape(-1, 8) for a in arrays]).T
    return len(arrays[0]).to_bytes(8, "little") + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def unpack(held: bytes, *kinds: type) -> list[np.ndarray]:
    n = int.from_bytes(held[:8], "little")
    planes = pa.Codec("zstd").decompress(held[8:], n * len(kinds) * 8, asbytes=True)
    numbers = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).reshape(-1)
    return [numbers[i * n * 8 : (i + 1) * n * 8].view(kind) for i, kind in enumerate(kinds)]


def asking_order(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a block asks for its hashes, by value, and the end of each part in it: parts are ranges of hashes."""
    order = np.argsort(hashes.view(np.uint64), kind="stable")
    of = (hashes.view(np.uint64)[order] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    return order, np.searchsorted(of, np.arange(parts, dtype=np.uint64), side="right")


def asked(blocks: Blocks, distinct: Callable[[pa.Table], tuple[np.ndarray, ...]]) -> DataFrame:
    """block, part, held: differences of the sorted hashes of a block in a part, and their counts, both by ``distinct``."""
    parts = blocks.parts

    def ask(cut: Iterator[tuple[int, pa.Table]]) -> Iterator[pa.RecordBatch]:
        for number, rows in cut:
            hashes, *counts = distinct(rows)
            order, ends = asking_order(hashes, parts)
            found, first = [], 0
            for part, end in enumerate(ends.tolist()):
                if end > first:
                    at = order[first:end]
                    found.append((part, pack(np.diff(hashes[at], prepend=np.int64(0)), *[c[at] for c in counts])))
                first = end
            arrays = [pa.array([number] * len(found), pa.int64()), pa.array([p for p, _ in found], pa.int32()), pa.array([h for _, h in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "part", "held"])

    return blocks.read(ask, ASKED)


def questions(group: pa.Table, n_counts: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hashes and counts of all blocks of a part, one block after the other, and the end of each block."""
    each = [unpack(held.as_py(), *[np.int64] * (1 + n_counts)) for held in group["held"]]
    hashes = [np.cumsum(e[0]) for e in each]
    join = lambda arrays: np.concatenate(arrays or [np.empty(0, np.int64)])
    return join(hashes), [join([e[i + 1] for e in each]) for i in range(n_counts)], np.cumsum([0, *map(len, hashes)])


def answers(group: pa.Table, ends: np.ndarray, *values: np.ndarray) -> pa.Table:
    """The values in the order in which each block asked for them."""
    held = [pack(*[v[a:b] for v in values]) for a, b in zip(ends[:-1], ends[1:])]
    return pa.Table.from_arrays([group["block"], group["part"], pa.array(held, pa.binary())], names=["block", "part", "held"])


def answered(group: pa.Table, order: np.ndarray, *kinds: type) -> list[np.ndarray]:
    """The answers to a block, beside the hashes that it asked for in ``order``."""
    found = [unpack(group["held"][i].as_py(), *kinds) for i in np.argsort(group["part"].to_numpy())]
    out = []
    for i, kind in enumerate(kinds):
        values = np.concatenate([f[i] for f in found] or [np.empty(0, kind)])
        if len(values) != len(order):
            raise ValueError(f"{len(order)} hashes of a block got {len(values)} answers")
        out.append(np.empty_like(values))
        out[-1][order] = values
    return out


def judged_rows(
    blocks: Blocks, found: Sequence[DataFrame], judge: Callable[[pa.Table, list[pa.Table]], list[np.ndarray]], ddl: str
) -> DataFrame:
    """key, doc_id, lang and the columns of ``ddl`` of each row, made by ``judge`` from the rows of a block and its answers in each of ``found``."""
    names = ["key", "doc_id", "lang"]
    columns = [c.split()[0] for c in ddl.split(", ")]
    kinds = len(found)
    answers_of = [f.select("block", F.lit(i).alias("kind"), "part", "held") for i, f in enumerate(found)]

    def read(block: pa.Table, group: pa.Table) -> pa.Table:
        if not len(block):
            raise ValueError("the rows of a block changed between two reads")
        rows = rows_of(block["held"][0].as_py())
        values = judge(rows, [group.filter(pc.equal(group["kind"], i)) for i in range(kinds)])
        return pa.Table.from_arrays([rows["key"], rows["doc_id"], rows["lang"].cast(pa.string()), *map(pa.array, values)], names=[*names, *columns])

    both = reduce(DataFrame.unionByName, answers_of)
    return blocks.table.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(read, f"key long, doc_id long, lang string, {ddl}")
