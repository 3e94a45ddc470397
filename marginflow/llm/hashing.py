"""Vectorized hashes of the words, shingles and windows of many texts at once."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

ODD = np.uint64(0x9E3779B97F4A7C15)
LARGEST = np.uint64(0xFFFFFFFFFFFFFFFF)
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
SOLID = ~BLANK


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that makes every bit depend on all bits (public splitmix64 constants)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """`n` fixed 64-bit values."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * ODD + np.uint64(salt * 0x632BE59BD9B4E019 % 2**64))


@cache
def _byte_values() -> np.ndarray:
    return seeds(256, 1)


_POWERS: dict[int, np.ndarray] = {}  # by base, as many as a text has needed


def powers_of(base: int, n: int) -> np.ndarray:
    """`base` ** 0, 1, ... modulo 2**64, at least `n`; one array is kept, whatever sizes are asked for."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(1 << max(12, (n - 1).bit_length()), np.uint64(base), dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base]


def powers(n: int) -> np.ndarray:
    return powers_of(int(ODD), n)[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and their starts (one more than texts). Null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return whole[starts[0] : starts[-1]], (starts - starts[0]).astype(np.int64)


class Words:
    """Words of many texts: `hash`, `begin` and `end` (bytes) of each, `first` of each text.

    `first` has one more entry than texts: text i has words first[i] to first[i + 1] - 1.
    Words are runs of bytes that are not ASCII white space. Equal words have equal hashes;
    two different words agree by chance only, as 64 bits do.
    """

    def __init__(self, texts: pa.Array, lines: bool = False):
        data, starts = text_bytes(texts)
        self.data, self.starts = data, starts
        n = len(data)
        solid = np.zeros(n + 2, dtype=bool)
        np.take(SOLID, data, out=solid[1:-1])
        # A text's first byte starts a word even if the text before ends in one.
        edge = np.zeros(n + 1, dtype=bool)
        edge[starts] = True
        now, before = solid[1:], solid[:-1]
        self.begin = np.flatnonzero(now & (~before | edge))
        self.end = np.flatnonzero(before & (~now | edge))
        self.first = np.searchsorted(self.begin, starts)
        self.first[-1] = len(self.begin)
        sums = np.zeros(n + 1, dtype=np.uint64)
        terms = np.take(_byte_values(), data)
        terms *= powers(max(n, 1))[:n]
        np.cumsum(terms, out=sums[1:])
        raw = (sums[self.end] - sums[self.begin]) * _inverse_powers(n)[self.begin]
        length = (self.end - self.begin).astype(np.uint64)
        self.hash = mixed(raw + length * np.uint64(0xD6E8FEB86659FD93))
        if lines:
            self._lines(edge)

    def _lines(self, edge: np.ndarray) -> None:
        """`line`: number of the line of each word, counted over all texts."""
        breaks = np.cumsum((self.data == 10) | edge[:-1])
        self.line = breaks[self.begin]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _inverse_powers(n: int) -> np.ndarray:
    return powers_of(pow(int(ODD), -1, 1 << 64), max(n, 1))


def shingles(hashes: np.ndarray, width: int, salt: int = 2) -> np.ndarray:
    """Hash of the `width` values that start at each position; they may run over a text's end."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    factor = seeds(width, salt) | np.uint64(1)
    for j in range(width):
        out += hashes[j : j + n] * factor[j]
    return mixed(out)


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row with repeats, and the starts of each text's.

    A text of fewer words than `width`, but at least one, has one shingle: all its words.
    """
    counts = words.counts
    n_shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(n_shingles)])
    out = np.empty(starts[-1], dtype=np.uint64)
    full = shingles(words.hash, width)
    long = counts >= width
    if long.any():
        owner = np.repeat(np.flatnonzero(long), n_shingles[long])
        nth = np.arange(len(owner)) - np.repeat(
            np.cumsum(n_shingles[long]) - n_shingles[long], n_shingles[long]
        )
        out[starts[owner] + nth] = full[words.first[owner] + nth]
    for n in range(1, width):
        some = np.flatnonzero(counts == n)
        own = words.hash[words.first[some][:, None] + np.arange(n)]
        factor = seeds(n, 3 + n) | np.uint64(1)
        out[starts[some]] = mixed((own * factor).sum(axis=1, dtype=np.uint64))
    return out, starts


def sliding(values: np.ndarray, width: int, combine=np.minimum) -> np.ndarray:
    """`combine` over the `width` values that start at each position."""
    if len(values) < width:
        return values[:0]
    reach, out = 1, values
    while reach * 2 <= width:
        out = combine(out[:-reach], out[reach:])
        reach *= 2
    if reach < width:
        rest = width - reach
        out = combine(out[:-rest], out[rest:])
    return out


def group_minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minimum of each group of consecutive values; LARGEST for an empty group."""
    sizes = np.diff(starts)
    out = np.full(len(sizes), LARGEST, dtype=np.uint64)
    some = sizes > 0
    if some.any():
        out[some] = np.minimum.reduceat(values, starts[:-1][some])
    return out


def bands(rows: int, bands: int, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(groups, bands) hashes: each band joins `rows` minima under their own permutations."""
    n = len(starts) - 1
    out = np.zeros((n, bands), dtype=np.uint64)
    salts = seeds(rows * bands, 5)
    for b in range(bands):
        key = np.full(n, (b + 1) * int(ODD) % 2**64, dtype=np.uint64)
        for r in range(rows):
            salt = salts[b * rows + r]
            # Another order of the values for each row of each band; they are mixed already.
            order = (values ^ salt) * (salt | np.uint64(1))
            order ^= order >> np.uint64(32)
            key = mixed(key + group_minima(order, starts))
        out[:, b] = key
    return out


def tune(similarity: float, recall: float, rows: int) -> int:
    """Bands of `rows` minima that find a pair of this similarity with at least this chance."""
    import math

    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
