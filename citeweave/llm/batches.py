"""Bounded slices of Arrow batches, and words as dictionary codes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``column`` holds about ``max_bytes``; a longer single text is its own run."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // max_bytes
    cut = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield batch.slice(a, b - a)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which lives on, gives the memory it no longer uses back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return whole


def words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word, row offsets) of ASCII-space separated words; null: none."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    split = pc.ascii_split_whitespace(text)
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    coded = flat.dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    offsets = offsets - offsets[0]
    blank = pc.equal(distinct, "").to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, bool)
    if blank.any():
        keep = ~blank[codes]
        kept = np.concatenate([[0], np.cumsum(keep)])
        codes, offsets = codes[keep], kept[offsets]
    return distinct, codes, offsets


def gather(values: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``values[bounds[c]:bounds[c+1]]`` over codes; also the number of values of each."""
    count = np.diff(bounds)[codes]
    ends = np.cumsum(count)
    if not len(codes) or not ends[-1]:
        return values[:0], count
    at = np.arange(ends[-1]) + np.repeat(bounds[:-1][codes] - (ends - count), count)
    return values[at], count
