"""Words and their 64-bit hashes straight from Arrow string buffers, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Byte values for the hash, with A-Z as a-z or as they are.
AS_IS = np.arange(1, 257).astype(np.uint64)
LOWER = AS_IS.copy()
LOWER[0x41:0x5B] = AS_IS[0x61:0x7B]

_USUAL = (1 << 20) + 4096
_powers = np.ones((2, 1), np.uint64)


def _power_tables(n: int) -> np.ndarray:
    """Powers of the base and of its inverse, at least ``n``; those beyond the usual run of texts are not kept."""
    global _powers
    if _powers.shape[1] >= n:
        return _powers
    steps = np.empty((2, max(n, _USUAL)), np.uint64)
    steps[0], steps[1] = _BASE, _INVERSE
    steps[:, 0] = 1
    powers = np.cumprod(steps, axis=1)
    if n <= _USUAL:
        _powers = powers
    return powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of rows of about ``most`` bytes; row k of a run is bytes[bounds[k]:bounds[k+1]].
    Nulls are empty."""
    if len(column) == 0:
        return
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
        stop = min(stop, len(column), row + 20_000)
        yield row, data[ends[row]:ends[stop]], ends[row:stop + 1] - ends[row]
        row = stop


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = AS_IS) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end) that depends on its bytes alone."""
    n = len(data)
    powers = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * powers[0, :n], out=total[1:])
    return mixed((total[end] - total[start]) * powers[1][start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of all maximal runs of other bytes within the rows."""
    inside = ~separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True  # a row begins here
    first = first[:len(data)]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1] | first[1:]
        ends[:-1] &= ~inside[1:] | first[1:]
    start = np.flatnonzero(begins)
    # Empty rows share their bound with the next row; the last row that begins at or before a word holds it.
    return start, np.flatnonzero(ends) + 1, np.searchsorted(bounds, start, "right") - 1


def line_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of all lines, without line feeds; an empty row is one empty line."""
    feeds = np.flatnonzero(data == 10)
    start = np.concatenate([bounds[:-1], feeds + 1])
    feed_row = np.searchsorted(bounds, feeds, "right") - 1
    row = np.concatenate([np.arange(len(bounds) - 1), feed_row])
    end = np.concatenate([feeds, bounds[1:]])
    end_row = np.concatenate([feed_row, np.arange(len(bounds) - 1)])
    order, end_order = np.lexsort((start, row)), np.lexsort((end, end_row))
    return start[order], end[end_order], row[order]
