"""Arithmetic modulo the prime 2^61 - 1 on numpy arrays of unsigned 64-bit."""

from __future__ import annotations

import numpy as np

P = (1 << 61) - 1
_P, _61, _31, _30 = np.uint64(P), np.uint64(61), np.uint64(31), np.uint64(30)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def add(a, b):
    return _reduced(a + b)


def sub(a, b):
    return _reduced(a + (_P - b))


def mul(a, b):
    """Products by halves of 31 and 30 bits: 2^62 = 2 and 2^61 = 1 here."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid = a1 * b0 + a0 * b1
    low = _reduced(a0 * b0)
    return _reduced(a1 * b1 * np.uint64(2) + (mid >> _30) + ((mid & _LOW30) << _31) + low)


def power(a: np.ndarray, e: int) -> np.ndarray:
    out = np.ones_like(a)
    while e:
        if e & 1:
            out = mul(out, a)
        a = mul(a, a)
        e >>= 1
    return out


def inverse(a: np.ndarray) -> np.ndarray:
    return power(a, P - 2)


def products(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Product of the rows of *values* for each run of equal *groups* (sorted),
    by pairing neighbours until one row is left of each."""
    while True:
        first = np.ones(len(groups), bool)
        first[1:] = groups[1:] != groups[:-1]
        starts = np.flatnonzero(first)
        place = np.arange(len(groups)) - np.repeat(starts, np.diff(np.append(starts, len(groups))))
        if not (place > 0).any():
            return groups, values
        left = np.flatnonzero(place % 2 == 0)
        paired = np.zeros(len(groups) + 1, bool)
        paired[:-1] = place % 2 == 1
        has = paired[left + 1]
        out = values[left]
        out[has] = mul(values[left[has]], values[left[has] + 1])
        groups, values = groups[left], out


def horner(coefficients: np.ndarray, degree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of monic polynomials.  *coefficients*: rows, lowest first and
    without the leading 1, zero beyond *degree*; *x* a value for each row."""
    out = np.zeros_like(x)
    for j in range(coefficients.shape[1], -1, -1):
        c = coefficients[:, j] if j < coefficients.shape[1] else np.zeros(len(x), np.uint64)
        out = add(mul(out, x), np.where(degree == j, np.uint64(1), np.where(degree > j, c, np.uint64(0))))
    return out


def solve(matrix: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gauss-Jordan over a stack of systems [n, rows, columns].  Returns the
    solutions (free unknowns 0), the ranks and whether each is consistent."""
    n, rows, cols = matrix.shape
    m = np.concatenate([matrix, right[:, :, None]], axis=2)
    rank = np.zeros(n, int)
    pivot_row = np.full((n, cols), -1)
    each = np.arange(n)
    for c in range(cols):
        able = (m[:, :, c] != 0) & (np.arange(rows)[None, :] >= rank[:, None])
        found = able.any(axis=1)
        if not found.any():
            continue
        k = each[found]
        pick, to = able[found].argmax(axis=1), rank[found]
        swap = m[k, pick].copy()
        m[k, pick] = m[k, to]
        swap = mul(swap, inverse(swap[:, c])[:, None])
        m[k, to] = swap
        factor = m[k, :, c].copy()
        factor[np.arange(len(k)), to] = 0
        m[k] = sub(m[k], mul(factor[:, :, None], swap[:, None, :]))
        pivot_row[k, c] = to
        rank[found] += 1
    beyond = np.arange(rows)[None, :] >= rank[:, None]
    consistent = ~((m[:, :, cols] != 0) & beyond).any(axis=1)
    solution = np.where(pivot_row >= 0, m[each[:, None], np.maximum(pivot_row, 0), cols], np.uint64(0))
    return solution, rank, consistent
