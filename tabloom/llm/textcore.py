"""Vectorised text primitives on Arrow string columns.

Every function works on the raw UTF-8 bytes of a whole batch of documents:
words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``, and hashes are
64-bit wrap-around arithmetic in numpy.  Nothing here keeps state between
batches, so a task that is run again gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_K = U64(0x9E3779B97F4A7C15)
#: Odd bases of the two polynomial hashes, and their inverses modulo 2**64.
BASE = (0xD1B54A32D192ED03, 0xABC98388FB8FAC03)
INVERSE = tuple(pow(b, -1, 1 << 64) for b in BASE)
#: Text bytes that are worked on at a time, unless one document is longer.
CHUNK = 1_000_000

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> U64(33))
    h *= _M1
    h ^= h >> U64(33)
    h *= _M2
    h ^= h >> U64(33)
    return h


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``most`` bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """The words of some documents: byte ranges, and each document's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        gap = SPACE[data]
        word = np.empty(len(data) + 1, bool)
        word[:-1] = ~gap
        word[-1] = False
        first = word.copy()
        first[1:] &= gap if len(data) else True
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        first[inner] = word[inner]
        self.starts = np.flatnonzero(first)
        last = word[:-1].copy()
        last &= ~word[1:] | first[1:]
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends - self.starts)


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on as a little-endian number, beyond the end zero."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 8,), "<u8", padded, 0, (1,))


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def range_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, by 8-byte lanes; meant for short ranges."""
    view = lanes(data)
    lengths = lengths.astype(np.int64)
    h = mix(lengths.astype(np.uint64) * _K + U64(seed + 1))
    h ^= view[starts] & _MASK[np.minimum(lengths, 8)]
    h = mix(h)
    left = np.flatnonzero(lengths > 8)
    done = 8
    while len(left):
        x = h[left] * _K
        x ^= view[starts[left] + done] & _MASK[np.minimum(lengths[left] - done, 8)]
        h[left] = mix(x)
        done += 8
        left = left[lengths[left] > done]
    return h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        up, down = np.full(size, BASE[which], np.uint64), np.full(size, INVERSE[which], np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        if size > 1 << 21:
            return up[:n], down[:n]
        _POWERS[which] = up, down
    up, down = _POWERS[which]
    return up[:n], down[:n]


def prefix_hash(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Rabin-Karp prefix sums, one more than values: any range's hash follows by :func:`span_hash`."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), which)[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """The hash of values[start:end], the same wherever the values stand."""
    down = powers(len(prefix), which)[1]
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _K)


def window_hashes(prefix: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """The hash of every window of ``size`` values."""
    n = len(prefix) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = prefix[size:] - prefix[:-size]
    out *= powers(n, which)[1]
    out += U64((size * int(_K)) % (1 << 64))
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, by block prefix and suffix minima."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start .. start + length, in order."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    starts = np.asarray(starts, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)


def covered(flags: np.ndarray, size: int) -> np.ndarray:
    """Which of the values lie in a flagged window; flags[i] is for the window of values i .. i + size."""
    step = np.zeros(len(flags) + size, np.int32)
    at = np.flatnonzero(flags)
    step[at] += 1
    np.subtract.at(step, at + size, 1)
    return np.cumsum(step[:-1]) > 0
