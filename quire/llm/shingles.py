"""Word shingles of whole texts as 64-bit values, in numpy over the bytes of an Arrow batch."""

from __future__ import annotations

import numpy as np

SEED, CHUNK = 20_240_601, 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(SEED + salt))


_BYTE = seeded(256, 1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, _U)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int = CHUNK):
    """Ranges of rows of about `most` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the number of words of each row."""
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(len(offsets) - 1, np.int64)
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.r_[False, word[:-1]] & ~first[:n]
    after = np.r_[word[1:], False] & ~first[1:]
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))
    return hashes, np.diff(np.searchsorted(start, offsets))


def shingle_sets(column, width: int):
    """The sorted distinct shingles of each row, in order: `width` words, or all words of a shorter text."""
    data, offsets = column_bytes(column)
    salt = seeded(width, 2) | _U(1)
    for a, b in runs(offsets):
        own = offsets[a : b + 1] - offsets[a]
        words, counts = word_hashes(data[offsets[a] : offsets[b]], own)
        m = len(words) - width + 1
        joined = np.zeros(0, _U)
        if m > 0:
            joined = words[:m] * salt[0]
            for i in range(1, width):
                joined = joined + words[i : i + m] * salt[i]
            joined = mix(joined)
        ends = np.cumsum(counts)
        for e, k in zip(ends.tolist(), counts.tolist(), strict=True):
            if k >= width:
                yield np.unique(joined[e - k : e - width + 1])
            elif k:
                yield mix(np.array([(words[e - k : e] * salt[:k]).sum(dtype=_U) + _U(k)], _U))
            else:
                yield np.zeros(0, _U)
