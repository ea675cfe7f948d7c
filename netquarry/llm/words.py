"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D, as in the pattern ``[^\\x20\\x09-\\x0D]+``.
Texts are handled whole, some megabytes of them at a time; memory follows the longest text of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLDEN = 0x9E3779B97F4A7C15
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Words of up to so many bytes are hashed together, eight bytes a step; longer ones one by one.
_SHORT = 64

CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def _seeded(seed: int) -> np.uint64:
    return mix64(np.array([(seed + 1) * _GOLDEN % 2**64], np.uint64))[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds of every word, and offsets of the rows in the words."""
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges[1:] - 1] = inside[edges[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of every word, offsets of the rows in the words, and the words' byte bounds.

    The state starts from length and seed, takes eight bytes a step and is mixed after each, so equal sums of bytes or
    periodic words do not meet; seeds give independent hashes.
    """
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, at = word_bounds(raw, offsets)
    text = np.zeros(len(raw) + 8, np.uint8)
    text[: len(raw)] = _LOWER[raw] if lower else raw
    eights = np.ndarray(len(raw) + 1, "<u8", text.data, strides=(1,))
    length, key = ends - starts, _seeded(seed)
    state = mix64(key + length.astype(np.uint64) * np.uint64(_GOLDEN))
    some = np.flatnonzero(length <= _SHORT)
    for k in range(0, _SHORT, 8):
        some = some[length[some] > k] if k else some
        if not len(some):
            break
        lane = eights[starts[some] + k] & _KEEP[np.minimum(length[some] - k, 8)]
        state[some] = mix64((state[some] ^ lane) * np.uint64(_GOLDEN) + key)
    for i in np.flatnonzero(length > _SHORT):
        digest = hashlib.blake2b(text[starts[i] : ends[i]].tobytes(), digest_size=8, key=int(key).to_bytes(8, "little")).digest()
        state[i] = int.from_bytes(digest, "little")
    return state, at, starts, ends


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive words, mixed after every word."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out ^ words[k : k + n]) * np.uint64(_GOLDEN)
        out ^= out >> np.uint64(32)
    return mix64(out)
