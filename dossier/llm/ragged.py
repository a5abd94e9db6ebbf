"""Arrays over a column of texts: words, their hashes and shingles, without a loop over rows.

An Arrow text column already is one run of bytes with offsets. The functions here find words and
hash them on that run. Long runs are handled in pieces cut between words, so that the temporary
arrays stay small whatever the length of a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice of a batch holds, unless one text alone is longer.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 4096
#: Bytes that are hashed together: their arrays stay in the cache.
HASH_BYTES = 1 << 16

# The ASCII white space that separates words (space, tab to carriage return).
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Everything but ASCII letters, digits and the bytes of other scripts.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)


def _byte_codes() -> np.ndarray:
    """A 64-bit code for each byte, the same for the upper and lower case of A to Z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    codes[65:91] = codes[97:123]
    return codes


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a one-to-one map)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = _byte_codes()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        steps = np.full((2, size), 1, dtype=np.uint64)
        steps[0, 1:] = _BASE
        steps[1, 1:] = pow(_BASE, -1, 1 << 64)
        _POWERS.clear()
        _POWERS[size] = tuple(np.multiply.accumulate(steps, axis=1))
    return _POWERS[size]


def text_run(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array and the offsets of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:][: len(column) + 1]
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


_TRIM = _trimmer()


def release() -> None:
    """Give memory of freed arrays back to the system; allocators else keep it while a worker lives,
    also while it waits and others need it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``size`` bytes (or one longer text), of few rows.

    After the last one freed memory is given back.
    """
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths.astype(np.int64)) - lengths) // size + np.arange(len(lengths)) // SLICE_ROWS
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))
    release()


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the offsets of each text in the list of words."""
    inside = ~separator[data]
    head = np.ones(len(data), dtype=bool)
    head[1:] = ~inside[:-1]
    tail = np.ones(len(data), dtype=bool)
    tail[:-1] = ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    head[cuts] = True
    tail[cuts - 1] = True
    starts = np.flatnonzero(inside & head)
    ends = np.flatnonzero(inside & tail) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given byte ranges, A to Z as lower case."""
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        # A piece ends with the last word that fits, or holds one word that alone is longer.
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + HASH_BYTES, "right")))
        lo, hi = int(starts[first]), int(ends[last - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_CODES[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        s, e = starts[first:last] - lo, ends[first:last] - lo
        out[first:last] = (sums[e] - sums[s]) * down[s]
        first = last
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a text, and the offsets of each text.

    A text of fewer words has one run, all its words; a text without words has none.
    """
    counts = np.diff(offsets)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(offsets[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    stop = np.repeat(offsets[1:], n)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        here = at + k
        valid = here < stop
        value = words[np.where(valid, here, 0)] if len(words) else out
        out = out * _SHINGLE + np.where(valid, value + np.uint64(1), np.uint64(0))
    return mix(out), bounds


def distinct_in_rows(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the new offsets."""
    if not len(values):
        return values, np.zeros(len(offsets), dtype=np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    counts = np.bincount(row[keep], minlength=len(offsets) - 1)
    return values[keep], np.concatenate([[0], np.cumsum(counts)])


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for an empty row."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def row_reduce(ufunc, values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over each row's values along the first axis; ``empty`` for rows without any."""
    counts = np.diff(offsets)
    out = np.full((len(counts), *values.shape[1:]), empty, dtype=values.dtype)
    if (counts > 0).any():
        out[counts > 0] = ufunc.reduceat(values, offsets[:-1][counts > 0], axis=0)
    return out
