"""Words and rolling hashes of many texts at once, on the UTF-8 bytes of an Arrow column.

Words are runs of bytes other than space and \\x09-\\x0D. All functions take the bytes of a
batch of texts laid end to end and the offsets of the texts in it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Base of the rolling hash, modulo 2**64; odd, so that its powers can be inverted.
BASE = 0x9E3779B97F4A7C15 | 1


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (uint8) and offsets (int64, from 0) of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes; a run never crosses a text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    firsts = offsets[:-1][offsets[:-1] < len(inside)]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[firsts] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[firsts[firsts > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    starts, ends = runs(~SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def word_counts(column: pa.Array) -> np.ndarray:
    data, offsets = flat(column)
    return np.diff(words(data, offsets)[2])


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i below n."""
    up, down = _powers(1 << max(16, int(n - 1).bit_length()))
    return up[:n], down[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE**i before each position; one more entry than bytes."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes whose sums are made at a time.
HASH_BYTES = (1 << 19) - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range: equal content, equal hash, wherever it stands.

    Ranges are in order of their starts and ends. Memory is bounded by HASH_BYTES or the longest range.
    """
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        begin = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + HASH_BYTES, "right")))
        part = data[begin:int(ends[last - 1])]
        sums, (_, down) = prefix(part), powers(len(part) + 1)
        a = starts[first:last] - begin
        out[first:last] = mix((sums[ends[first:last] - begin] - sums[a]) * down[a])
        first = last
    return out
