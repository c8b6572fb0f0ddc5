"""Word and fingerprint helpers over Arrow batches.

Text stays in Arrow's UTF-8 buffer; words, their hashes and word windows are
numpy arrays over it, so no Python object is made per word. Memory follows
``SLICE_BYTES`` (or the longest single text), never the size of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
#: A second base, whose fingerprints are independent of those of the first.
CHECK_BASE = 0xC2B2AE3D27D4EB4F
_powers: dict[int, np.ndarray] = {}

#: Bytes that part words: space and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII bytes other than digits and lower-case letters.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: A to Z as a to z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut the batches into runs of rows with at most so many bytes of text, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, min(end, n) - at)
            at = min(end, n)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, one after another, and where each begins (one more at the end). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and where each text's words begin in those arrays."""
    inside = ~parts[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = first[first > 0] - 1
    after[last] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    if len(known := _powers.get(base, np.zeros(0, np.uint64))) < n:
        step = np.full(-(-n // (1 << 19)) * (1 << 19), base, np.uint64)
        step[0] = 1
        known = _powers[base] = np.multiply.accumulate(step)
    return known[:n]


def prefix_sums(data: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Sums from which ``range_hash`` takes the fingerprint of any range of bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(base, len(data)), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit fingerprints of the bytes from starts to ends, alike wherever those bytes stand; never 0."""
    inverse = _power(pow(base, -1, 1 << 64), len(sums))
    x = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    x[x == 0] = 1
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of words: sums of well-mixed numbers of each byte and its place in the word; never 0."""
    size = ends - starts
    upto = np.cumsum(size)
    out, at = np.zeros(len(size), np.uint64), 0
    while at < len(size):
        # Words of half a MB at a time, or one longer word, for the sake of memory.
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 19), "right")))
        n = size[at:end]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        byte = data[place + np.repeat(starts[at:end], n)]
        each = mix(((place.astype(np.uint64) << np.uint64(8)) | byte) * np.uint64(_BASE) + np.uint64(0x632BE59BD9B4E019))
        out[at:end] = np.add.reduceat(each, first)
        at = end
    out = mix(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    out[out == 0] = 1
    return out


def text_of_words(first: np.ndarray) -> np.ndarray:
    """For each word, the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of n words that lie in one text, and the word each starts with."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])
    at = np.flatnonzero(left >= n)
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        total += hashes[at + j] * np.uint64(pow(_BASE, 3 * j + 1, 1 << 64))
    return mix(total), at
