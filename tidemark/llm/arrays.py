"""Byte, word and hash arrays over an Arrow text column.

The helpers here run inside tasks. They turn a column of UTF-8 texts into flat
numpy arrays, a few megabytes at a time, so that no Python object is made for
a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Everything but space and the controls 9 to 13.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: ASCII digits and lower-case letters, and every byte of a character beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = True
ALPHANUMERIC[97:123] = True
ALPHANUMERIC[128:] = True

_powers = np.ones(1, np.uint64)
_inverse_powers = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) <= n:
        length = max(n + 1, CHUNK + 1)
        for_all = np.full(length, _BASE)
        for_all[0] = 1
        _powers = np.cumprod(for_all)
        for_all[1:] = _BASE_INVERSE
        _inverse_powers = np.cumprod(for_all)
    return _powers, _inverse_powers


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = values ^ (values >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column, and where each row begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_bytes[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets) of runs of rows with about ``limit`` bytes; a longer text stands alone."""
    data, offsets = flat(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, stop, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hash` takes the hash of any span."""
    powers, _ = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal bytes have equal hashes wherever they stand."""
    _, inverse = _power_tables(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes in ``inside``, never across rows), and the first word of each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[data]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = mask[firsts]
    finishes = mask.copy()
    finishes[:-1] &= ~mask[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    finishes[lasts] = mask[lasts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the first word of each row."""
    starts, ends, first = words(data, offsets, inside)
    return span_hash(prefix_sums(data), starts, ends), first


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words within each row, and the first n-gram of each row."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], counts)
    out = np.full(len(starts), np.uint64(n))
    for k in range(n):
        out = mix(out * _BASE + hashes[starts + k])
    return out, at


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The whole numbers of all [start, start + length), one range after the other."""
    total = np.cumsum(lengths)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - lengths), lengths)
