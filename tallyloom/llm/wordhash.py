"""Vectorised words, word hashes and shingles over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z are lowered first. A word's
64-bit value chains its bytes, eight at a time, through a bijective mixer, and is a BLAKE2b digest if the
word is long: no family of words has one value by construction, as with polynomials modulo 2**64. Equal words get equal
values in every batch, task and run. Callers that need certainty compare the bytes.
"""

from __future__ import annotations

import ctypes
import sys
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_LONG = 32  # bytes beyond which a word's value is a digest

_space = np.zeros(256, dtype=bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, longest: int = _LONG) -> np.ndarray:
    """A 64-bit value of each span of ``data``; ``data`` has eight bytes after its last span. Spans over ``longest`` bytes are digested one by one."""
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", buffer=data, strides=(1,))  # the eight bytes at each place
    out = mix(sizes.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    live = np.flatnonzero((sizes > 0) & (sizes <= longest))
    k = 0
    while len(live):
        left = sizes[live] - k
        chunk = eight[starts[live] + k] & _MASKS[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ chunk)
        k += 8
        live = live[left > 8]
    for i in np.flatnonzero(sizes > longest).tolist():
        a = int(starts[i])
        out[i] = int.from_bytes(blake2b(data[a : a + int(sizes[i])], digest_size=8).digest(), "little")
    return out


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit value of each word in order, number of words of each text)."""
    raw, offsets = text_buffer(column)
    docs = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    inside = ~_space[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    before[firsts] = False  # a text's first byte starts a word even if the text before ends with one
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:] & before[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    data = np.zeros(len(raw) + 8, np.uint8)
    np.take(_lower, raw, out=data[: len(raw)])
    return hash_spans(data, starts, ends - starts), counts


def span_hashes(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit value of each span of 32-bit code points, equal for equal spans."""
    data = np.append(points, np.zeros(2, points.dtype)).view(np.uint8)
    return hash_spans(data, starts * 4, (stops - starts) * 4, longest=256)


def shingles(values: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(value of each run of ``size`` words, runs of each text); shorter texts are one run, empty ones none."""
    docs = len(counts)
    starts = np.concatenate(([0], np.cumsum(counts)))
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    acc = np.zeros(max(len(values) - size + 1, 0), np.uint64)
    for k in range(size if len(acc) else 0):
        acc = mix(acc ^ values[k : k + len(acc)])
    owner = np.repeat(np.arange(docs), per)
    first = np.concatenate(([0], np.cumsum(per)))
    where = starts[owner] + (np.arange(first[-1]) - first[owner])
    out = np.zeros(first[-1], np.uint64)
    long_enough = counts[owner] >= size
    out[long_enough] = mix(acc[where[long_enough]] + np.uint64(size))
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        v = values[starts[i] : starts[i + 1]]
        total = np.zeros(1, np.uint64)
        for k in range(len(v)):
            total = mix(total ^ v[k : k + 1])
        out[first[i]] = mix(total + np.uint64(len(v)))[0]
    return out, per


def slices(batch: pa.RecordBatch, text: str, most: int = 2 << 20):
    """Cut a batch so that a piece has at most ``most`` bytes of text, or is one row."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = text_buffer(batch.column(text))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    _release()


_libc = ctypes.CDLL(None) if sys.platform == "linux" else None


def _release() -> None:
    """Give freed memory back: a worker lives on after its task, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
