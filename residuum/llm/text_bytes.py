"""Vectorised passes over the bytes of a batch of texts.

Texts come as Arrow string arrays, whose bytes lie in one buffer; features are
computed for all of them at once, a few hundred thousand bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once, about; a longer text is a piece of its own. Arrays of up
#: to eight bytes for each stay in a worker's memory, so this is small.
CHUNK = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters (a-z in lower case, all of UTF-8's upper half) as they are; the rest as space.
LETTERS = np.full(256, 32, dtype=np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a null text is empty.

    ``offsets`` has one entry more than there are rows and starts at 0.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, side="right")) - 1)
        yield row, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def gram_buckets(data: np.ndarray, bits: int) -> np.ndarray:
    """A bucket of ``2 ** bits`` for the three bytes from each position on."""
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    x = data.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - bits)


def inside(offsets: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first window of ``width`` bytes and the end of its windows."""
    start, end = offsets[:-1], offsets[1:]
    return start, np.maximum(start, end - (width - 1))


def sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of ``values[start:end]`` for each pair."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[np.minimum(end, len(values))] - total[np.minimum(start, len(values))]


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_RADIX = np.uint64(0x5851F42D4C957F2D)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSE = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the radix and of its inverse modulo 2 ** 64."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, CHUNK + 1024)
        base = np.full(size, _RADIX, dtype=np.uint64)
        base[0] = 1
        _POWERS = np.cumprod(base)
        base[1:] = np.uint64(pow(int(_RADIX), -1, 1 << 64))
        _INVERSE = np.cumprod(base)
    return _POWERS[:n], _INVERSE[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without space and \\x09-\\x0D) and each row's offsets in them.

    With ``lower``, A-Z count as a-z. No word reaches from one row into the next.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    gap = _SPACE[data]
    # A word starts at a non-space after a space or a row's start.
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = gap[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = True
    start = np.flatnonzero(~gap & before)
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = gap[1:]
    after[edges[edges > 0] - 1] = True
    end = np.flatnonzero(~gap & after) + 1
    power, inverse = _powers(n + 1)
    codes = _BYTE[_LOWER[data] if lower else data]
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes * power[:n], out=total[1:])
    hashes = mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and each row's offsets in them.

    A row with fewer words, but one at least, has all of them as its one shingle.
    """
    count = np.diff(offsets)
    own = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    ends = np.concatenate([[0], np.cumsum(own)])
    out = np.zeros(int(ends[-1]), dtype=np.uint64)
    row = np.repeat(np.arange(len(count)), own)
    first = np.arange(len(out)) - ends[row] + offsets[row]
    used = np.minimum(count[row], width)
    for k in range(width):
        live = k < used
        at = np.minimum(first + k, max(len(words) - 1, 0))
        part = np.where(live, words[at] if len(words) else np.uint64(0), np.uint64(0))
        out = mix64(out * _RADIX + part + np.uint64(k + 1)) if len(out) else out
    return mix64(out + used.astype(np.uint64)), ends
