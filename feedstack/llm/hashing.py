"""Words and word shingles of whole Arrow columns as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np

from .common import SPACES

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
#: One random value for each byte; A-Z get those of a-z.
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_VALUE_CASED = _VALUE.copy()
_VALUE[65:91] = _VALUE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_ODD = _rng.integers(1, 1 << 62, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, as far as needed so far."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, cased: bool = False) -> np.ndarray:
    """Hash of each byte span [start, end): a polynomial over the span's bytes, from running sums."""
    up, down = power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_VALUE_CASED if cased else _VALUE)[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _ODD[0])


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that cross no bound: starts, ends and each run's row."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(bounds, start, side="right") - 1


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) and the row that holds it."""
    start, end, row = spans(~_IS_SPACE[data], bounds)
    return span_hashes(data, start, end), row


def shingles(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words and its row; a row with 1 to k-1 words has its whole sequence as one."""
    h, row = words(data, bounds)
    n = len(h)
    if n == 0:
        return h, row
    run = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        run += mix(h[j:j + len(run)] * _ODD[j + 1] + _ODD[j + 2])
    whole = row[:len(run)] == row[k - 1:k - 1 + len(run)]
    run, at = mix(run[whole]), row[:len(run)][whole]
    counts = np.bincount(row, minlength=len(bounds) - 1)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(row, short)
        extra = np.array([mix(np.sum(mix(h[f:f + c] * _ODD[1:c + 1] + _ODD[40]), keepdims=True) + _U(c))[0]
                          for f, c in zip(first, counts[short], strict=True)], np.uint64)
        run, at = np.concatenate([run, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        run, at = run[order], at[order]
    return run, at


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of every row, ascending."""
    run, at = shingles(data, bounds, k)
    cut = np.searchsorted(at, np.arange(len(bounds)))
    return [np.unique(run[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
