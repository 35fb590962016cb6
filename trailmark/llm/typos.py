"""Letters dropped from some words, chosen by a checksum of document and word."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

ONE_IN = 97
# The step of a byte b is ~crc32(b ^ 255) ^ 0xFFFFFF, as a checksum starts from all ones and is inverted at its end.
TABLE = np.array([zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], np.uint32)
LONG = 64


def crc32_of_words(before: np.ndarray, data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each word, going on from the checksum of what comes before it."""
    size = end - first
    order = np.argsort(-size, kind="stable")
    state = before[order] ^ np.uint32(0xFFFFFFFF)
    start, size = first[order], size[order]
    for at in range(min(LONG, int(size[0]) if len(size) else 0)):
        live = int(np.searchsorted(-size, -at, side="left"))
        state[:live] = TABLE[(state[:live] ^ data[start[:live] + at]) & np.uint32(0xFF)] ^ (state[:live] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-size, -LONG, side="left"))):
        state[i] = zlib.crc32(data[start[i] + LONG : start[i] + size[i]], int(state[i]))
    out = np.empty(len(state), np.uint32)
    out[order] = state
    return out


def drop_letters(ids: pa.Array, data: np.ndarray, first: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Words whose crc32 of ``<doc_id>:<word>`` is divisible by 97 lose the code point at that number modulo their length.

    A null id counts as the empty text.
    """
    heads = np.array([zlib.crc32(b"%s:" % (b"" if i is None else b"%d" % i)) for i in ids.to_pylist()], np.uint32)
    h = crc32_of_words(heads[row], data, first, end)
    chosen = np.flatnonzero(h % ONE_IN == 0)
    words = [data[a:b].tobytes().decode() for a, b in zip(first[chosen], end[chosen])]
    cuts = [int(k) % len(w) for k, w in zip(h[chosen], words)]
    return chosen, [w[:k] + w[k + 1 :] for k, w in zip(cuts, words)]
