"""Word spans and window hashes of whole columns of text, computed on their bytes with NumPy.

All functions work on one block: the bytes of some texts, one after the other, and their
offsets. Words and windows never cross the border of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# bytes of text per block; a longer text is a block of its own
BLOCK_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_RANDOM = np.random.Generator(np.random.PCG64(20_240_229))
_BYTE_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_WORD_CODES = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True

_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        size = max(n, BLOCK_BYTES + 1)
        known = np.full(size, base, dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if size <= 2 * BLOCK_BYTES:
            _powers[int(base)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`range_hashes` takes the hash of any byte range."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * _power_table(_BASE, len(data)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = _power_table(_BASE_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * _WORD_CODES[63])


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of blocks of at most ``BLOCK_BYTES``; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        low = offsets[first]
        yield first, data[low:offsets[last]], offsets[first:last + 1] - low
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every word, in order."""
    inside = is_word[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0], before[1:] = False, inside
    after = np.empty(len(data) + 1, dtype=bool)
    after[-1], after[:-1] = False, inside
    before[offsets] = False  # a text begins without a word
    after[offsets] = False  # and ends without one
    start = np.flatnonzero(inside & ~before[:-1])
    end = np.flatnonzero(inside & ~after[1:]) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hashes(prefix_hashes(data), start, end)


def windows(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of ``size`` words inside one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    total = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        total += hashes[j:j + n] * _WORD_CODES[j % 63]
    first = np.flatnonzero(owner[:n] == owner[size - 1:size - 1 + n])
    return first, mix(total[first])


def merged_length(start: np.ndarray, length: np.ndarray) -> int:
    """Number of positions under the union of runs whose starts ascend."""
    if not len(start):
        return 0
    end = np.maximum.accumulate(start + length)
    return int(end[-1] - start[0] - np.maximum(start[1:] - end[:-1], 0).sum())
