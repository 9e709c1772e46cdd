"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

Bytes are classed by table lookup. Each (lower-cased) byte and its place in the word name a pseudo-random number; a word's hash is the sum of its bytes' numbers, taken from running
sums, then mixed with its length. (A polynomial modulo 2**64 would do without the mixing of each byte, but has words of 1,024 letters that collide for every base.) Work goes in chunks of whole texts, about 64 kB each, so memory follows the longest text at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
# Odd multipliers and the seed of the byte table.
P, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(MIX1)
    x = (x ^ (x >> U(27))) * U(MIX2)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def _tables(drop: bytes) -> tuple[np.ndarray, np.ndarray]:
    value = mix(np.arange(1, 257, dtype=U) * U(P)) | U(1)
    for c in range(65, 91):
        value[c] = value[c + 32]
    space = np.zeros(256, bool)
    space[list(drop)] = True
    return value, space


def word_hashes(data: np.ndarray, drop: bytes = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the runs of bytes outside drop."""
    value, space = _tables(drop)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    inside = ~space[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    lengths = ends - starts
    upto = np.cumsum(lengths)
    place = np.arange(int(upto[-1]) if len(upto) else 0, dtype=U) - np.repeat((upto - lengths).astype(U), lengths)
    run = np.zeros(len(place) + 1, U)
    np.cumsum(mix(value[data[inside]] + place * U(P)), out=run[1:])
    hashes = mix(run[upto] - run[upto - lengths] + lengths.astype(U) * U(MIX2))
    return starts, ends, hashes


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data, offsets


def each_text(column: pa.Array, drop: bytes = SPACES, chunk: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text: its place, bytes, and starts, ends, hashes of its words. A text ends a word, whatever follows."""
    data, offsets = text_bytes(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk, "right")) - 1)
        j = min(j, n)
        low = int(offsets[i])
        # A space after each text keeps words of neighbours apart.
        sizes = np.diff(offsets[i : j + 1])
        at = offsets[i : j + 1] - low + np.arange(j - i + 1)
        joined = np.full(int(at[-1]), 32, np.uint8)
        if sizes.sum():
            keep = np.ones(len(joined), bool)
            keep[at[1:] - 1] = False
            joined[keep] = data[low : int(offsets[j])]
        starts, ends, hashes = word_hashes(joined, drop)
        cut = np.searchsorted(starts, at)
        for k in range(j - i):
            a, b = cut[k], cut[k + 1]
            yield i + k, joined[at[k] : at[k + 1] - 1], starts[a:b] - at[k], ends[a:b] - at[k], hashes[a:b]
        i = j


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of k words; with fewer words, of the whole sequence; without words, none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    x = np.full(n - width + 1, U(width))
    for i in range(width):
        x = mix(x * U(P) + hashes[i : n - width + 1 + i])
    return np.unique(x)
