"""Words of whole texts as 64-bit hashes, a block of documents at a time.

A block is the UTF-8 data of several texts end to end plus their offsets, as Arrow stores
a string column; nothing is decoded.  Blocks are bounded by bytes, so memory in a task
does not depend on how many rows an Arrow batch holds; one text is never split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: a task holds some 100 bytes for each byte of a block
BLOCK_BYTES = 1 << 18

_rng = np.random.default_rng(20240607)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def _byte_codes(fold: bool) -> np.ndarray:
    codes = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes


CODES = _byte_codes(fold=True)

# What is part of a word, by byte.
#: anything but blank, tab, line feed, vertical tab, form feed, carriage return
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: ASCII digits and letters and everything outside ASCII
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * BLOCK_BYTES + 1)
        for k, base in enumerate((_P, _P_INV)):
            run = np.full(size, base)
            run[0] = 1
            _powers[k] = np.cumprod(run)
    return _powers[0][:n], _powers[1][:n]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Yield (first row, data, offsets) for runs of rows of at most ``limit`` bytes, or one row."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1, row + 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACED):
    """Hashes of all words (A-Z as a-z), the words' first row offsets, and their byte ranges.

    Returns (hashes, first, starts, ends): the words of text i are first[i]:first[i+1].
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), np.zeros(len(offsets), np.int64), none, none
    inside = parts[data]
    edge = offsets[1:-1][offsets[1:-1] < len(data)]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[edge] = inside[edge]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = edge[edge > 0] - 1
    closes[last] = inside[last]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets), starts, ends


_SHINGLE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_of(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one text; of the whole text where it is shorter."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += words[k : k + n] * _SHINGLE[k]
    return mix(total)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """The sorted set of run hashes of one text."""
    return np.unique(runs_of(words, width))
