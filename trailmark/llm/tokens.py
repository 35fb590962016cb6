"""Vectorised token work inside tasks: bytes and words of a block of documents, and their hashes."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LAST_ID = np.iinfo(np.int64).max


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the entropy of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * BASE) | np.uint64(1)


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype)


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    up, down = np.full(n, BASE), np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Sorts (doc_id, text) rows by id, then text; null ids last.

    Returns the UTF-8 bytes of all texts, the n + 1 offsets of the rows, comparable ids, and the ids.
    """
    rows = table.select(["doc_id", "text"])
    order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_end")
    rows = rows.take(order)
    ids = rows["doc_id"].combine_chunks()
    text = pc.fill_null(rows["text"], "").cast(pa.large_binary()).combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_binary())
    if isinstance(ids, pa.ChunkedArray):
        ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], pa.int64())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    held = text.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and len(held) else np.empty(0, np.uint8)
    return data, offsets - offsets[0], pc.fill_null(ids, LAST_ID).to_numpy(zero_copy_only=False).astype(np.int64), ids


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every word, and the n + 1 word offsets of the rows. No word crosses rows."""
    solid = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, from prefix sums of a polynomial in its bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + CHUNK, side="right")))
        b = ends[j - 1]
        up, down = powers(max(2 * CHUNK, 1 << int(b - a).bit_length()))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTE_CODES[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k consecutive tokens, built by doubling."""
    out, done, block, size, weight = None, 0, x, 1, BASE
    while True:
        if k & size:
            if out is None:
                out, done = block, size
            else:
                n = len(block) - done
                out = out[:n] * weight + block[done : done + n]
                done += size
        if done == k:
            return mix(out)
        block = block[:-size] * weight + block[size:]
        weight, size = np.uint64(int(weight) ** 2 % (1 << 64)), size * 2


def window_hashes(x: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` tokens from each start."""
    h = np.zeros(len(starts), np.uint64)
    for i in range(width):
        h = h * BASE + x[starts + i]
    return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x
