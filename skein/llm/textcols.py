"""Whole text columns as byte arrays: splitting into words without a Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
#: A-Z to a-z, all other bytes as they are.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, a-z, all beyond ASCII.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: Bytes of `[^\x20\x09-\x0D]+`.
NOT_WHITE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(column, pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, ptr): byte ranges of the words, those of document i at ptr[i] to ptr[i + 1].

    ``word`` says which bytes belong to words; a document's edges end words too.
    """
    edge = np.zeros(len(data) + 2, bool)
    edge[1:-1] = word[data]
    inside = edge[1:-1]
    start, end = inside & ~edge[:-2], inside & ~edge[2:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(start, offsets)


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(id of each word, distinct words as a binary array), by Arrow's dictionary encoding."""
    if not len(start):
        return np.empty(0, np.int32), pa.array([], pa.large_binary())
    size = end - start
    mark = np.zeros(len(data) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    kept = data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    coded = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(kept))]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def expand(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices lo[i] .. lo[i] + size[i] - 1 for all i in a row, and the i of each."""
    owner = np.repeat(np.arange(len(size)), size)
    before = np.cumsum(size) - size
    return np.arange(len(owner)) - before[owner] + lo[owner], owner


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (uint64 in and out)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
