"""Runs of rows of Arrow batches, cut so that a task works on a few megabytes of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets of the rows; a null text is empty."""
    binary = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    held = binary.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.cumsum(size)
        a = 0
        while a < batch.num_rows:
            before = int(upto[a] - size[a])
            b = max(a + 1, int(np.searchsorted(upto, before + most, side="right")))
            yield batch.slice(a, b - a)
            a = b
