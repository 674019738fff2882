"""Words of byte texts and their 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
#: Bytes that end a word: space and U+0009 to U+000D.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes that end a word where punctuation does: all ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look independent."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed_int(x: int) -> np.uint64:
    return mixed(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0][0]) < n:
        tables = []
        for base in (_ODD, _INVERSE):
            table = np.full(max(n, 1 << 18), np.uint64(base))
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        if n > 1 << 22:
            return tables[0], tables[1]
        _powers[:] = [(tables[0], tables[1])]
    return _powers[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every word and the byte after it; no word reaches over the end of its text."""
    inside = ~ends_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each span of bytes: a polynomial of its bytes, then mixed."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    terms = sums[1:]  # in place, for a worker keeps the memory of its largest arrays
    terms[:] = data
    terms += np.uint64(1)
    terms *= power[: len(data)]
    np.cumsum(terms, out=terms)
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words, the place of each text's first word among them, word starts and ends."""
    starts, ends = word_bounds(data, offsets, ends_word)
    hashes = span_hashes(LOWER[data], starts, ends)
    return hashes, np.searchsorted(starts, offsets), starts, ends


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words of one text, in order, at the same cost for any size; none if it has fewer words."""
    n = len(words)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _power_tables(n + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * power[:n], dtype=np.uint64)])
    return mixed((sums[size:] - sums[:-size]) * inverse[: n - size + 1] + np.uint64(size))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words of one text, in order; of all its words as one run if it has fewer."""
    n = len(words)
    width = min(size, n)
    if width == 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        total = total * np.uint64(_ODD) + words[k : n - width + 1 + k]
    return mixed(total + np.uint64(width))
