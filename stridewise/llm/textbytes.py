"""Vectorised work on the UTF-8 bytes of Arrow text columns.

A column's values lie one after another in a single buffer, so words of a
whole batch are found and hashed with a handful of numpy passes instead of a
Python call per word. Null texts are empty texts here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that one slice holds at most, unless a single text is longer.
SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is True for bytes outside all the given closed ranges."""
    found = np.ones(256, dtype=bool)
    for low, high in ranges:
        found[low : high + 1] = False
    return found


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of a text column, in row order.

    offsets has one more entry than the slice has rows and starts at 0.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the maximal runs of word bytes inside each row."""
    mask = is_word[data]
    size = len(mask)
    if not size:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    before = np.empty(size, bool)
    before[0] = False
    before[1:] = mask[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < size]
    before[inner] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(size, bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) <= size:
        length = max(size + 1, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            factors = np.full(length, base, dtype=np.uint64)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs that depend on their bytes alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes; the caller drops runs that cross rows."""
    count = max(0, len(words) - k + 1)
    total = np.zeros(count, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : j + count]
    return mix(total)


def same_row(rows: np.ndarray, k: int) -> np.ndarray:
    """For each run of k consecutive words, whether it lies in one row."""
    count = max(0, len(rows) - k + 1)
    return rows[:count] == rows[k - 1 : k - 1 + count]
