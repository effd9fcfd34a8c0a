"""Words of Arrow texts by their bytes, without a Python object for each word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words between white space, and of words of letters (any byte outside ASCII belongs to a letter).
VISIBLE = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LETTERS = np.array([i >= 0x80 or chr(i).isalpha() for i in range(256)])
LOWER = np.array([i + 32 if 0x41 <= i <= 0x5A else i for i in range(256)], np.uint8)


@dataclass
class Words:
    """All words of some texts in order; those of text i are from starts[i] to starts[i + 1]."""

    values: pa.LargeStringArray
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


def words(texts: pa.Array | pa.ChunkedArray, inside: np.ndarray, lower: bool = False) -> Words:
    """Runs of bytes that inside holds for; a null text has none. lower: A-Z become small letters, nothing else changes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return Words(pa.array([], pa.large_string()), np.zeros(1, np.int64))
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    held = inside[data]
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    first = bounds[:-1][bounds[:-1] < len(data)]
    begins[first] = held[first]  # a text's first word, though the text before it ends in one
    at = np.flatnonzero(begins)
    packed = data[held]
    if lower:
        packed = LOWER[packed]
    ends = np.append(np.cumsum(held, dtype=np.int32 if len(held) < 2**31 else np.int64)[at].astype(np.int64) - 1, len(packed))
    values = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(packed))
    return Words(values, np.searchsorted(at, bounds))
