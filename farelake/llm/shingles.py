"""Word and shingle hashes of Arrow text batches, in numpy.

A word's hash is a polynomial over random 64-bit codes of its bytes, taken for
all words of a piece at once from one running sum; a shingle's hash mixes the
hashes of its words. Two different shingles of two compared documents agree
with a chance of about 2 ** -64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text whose hashes are held at once in a task; powers of the hash base are kept up to MOST_POWERS.
PIECE_BYTES = 1 << 18
MOST_POWERS = 1 << 22

_random = np.random.default_rng(20240607)
_CODES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_CODES[65:91] = _CODES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
# Separators when words are runs of ASCII letters and digits and of all other characters beyond ASCII.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[128:] = False
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    PUNCTUATION[_low:_high] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base (or of its inverse) modulo 2 ** 64."""
    name = "inverse" if inverse else "base"
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 1)
        steps = np.full(size, _UNBASE if inverse else _BASE, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= MOST_POWERS:
            _powers[name] = have
    return have[:n]


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about PIECE_BYTES of text; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a piece, A-Z lower-cased, and each document's range of them (n + 1 bounds)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~separators[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    begins[edge] = word[edge]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = word[last]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[data] * powers(n), out=running[1:])
    hashes = scramble((running[stop] - running[start]) * powers(n, inverse=True)[start])
    return hashes, np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word runs of ``size``; the whole sequence as one when it is shorter."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        return scramble(np.array([(words * _PLACE[:n]).sum() + np.uint64(n)], np.uint64))
    h = words[:n - size + 1] * _PLACE[0]
    for k in range(1, size):
        h = h + words[k:n - size + 1 + k] * _PLACE[k]
    return np.unique(scramble(h))


def document_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each document of a batch."""
    for first, data, offsets in pieces(column):
        words, bounds = word_hashes(data, offsets)
        for k in range(len(offsets) - 1):
            yield first + k, shingle_hashes(words[bounds[k]:bounds[k + 1]], size)
