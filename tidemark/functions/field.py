"""Arithmetic modulo the prime 2^61 - 1: on arrays, and on polynomials of Python integers."""

from __future__ import annotations

import numpy as np

P = (1 << 61) - 1
_P = np.uint64(P)
_LOW32, _LOW29 = np.uint64(0xFFFFFFFF), np.uint64((1 << 29) - 1)
_3, _29, _32, _61 = (np.uint64(n) for n in (3, 29, 32, 61))


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of uint64 arrays of residues. 2^61 is 1, so high parts fold down."""
    ah, al, bh, bl = a >> _32, a & _LOW32, b >> _32, b & _LOW32
    middle, low = ah * bl + al * bh, al * bl
    s = ((ah * bh) << _3) + (middle >> _29) + ((middle & _LOW29) << _32) + (low & _P) + (low >> _61)
    s = (s & _P) + (s >> _61)
    return np.where(s >= _P, s - _P, s)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + (_P - b))


def power(a: np.ndarray, n: int) -> np.ndarray:
    out = np.ones_like(a)
    while n:
        if n & 1:
            out = mul(out, a)
        a, n = mul(a, a), n >> 1
    return out


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverses; of 0 it is 0. A few are cheaper one by one than by some 120 array products."""
    if a.size < 500:
        return np.array([pow(x, -1, P) if x else 0 for x in map(int, a.ravel())], np.uint64).reshape(a.shape)
    return power(a, P - 2)


def products(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Product of the rows ``offsets[i]:offsets[i+1]`` of ``values``, for each i; 1 for none."""
    size = np.diff(offsets)
    out = np.ones((len(size), *values.shape[1:]), np.uint64)
    for k in range(int(size.max(initial=0))):  # the k-th row of each group; groups are small
        at = np.flatnonzero(size > k)
        out[at] = mul(out[at], values[offsets[at] + k])
    return out


def solve(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solve systems ``a[:, :, :d] x = a[:, :, d]``; returns x, and which systems are regular."""
    n, d, _ = a.shape
    a, fine, each = a.copy(), np.ones(n, bool), np.arange(n)
    for c in range(d):
        row = c + np.argmax(a[:, c:, c] != 0, axis=1)
        fine &= a[each, row, c] != 0
        a[each, row], a[each, c] = a[each, c].copy(), a[each, row].copy()
        a[:, c] = mul(a[:, c], inverse(a[:, c, c])[:, None])
        for r in range(d):
            if r != c:
                a[:, r] = sub(a[:, r], mul(a[:, c], a[:, r, c][:, None]))
    return a[:, :, d], fine


def evaluate(monic: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Values at ``z`` of monic polynomials; ``monic[:, i]`` is the coefficient of x^i below the leading 1."""
    out = np.ones((len(monic), len(z)), np.uint64)
    for i in range(monic.shape[1] - 1, -1, -1):
        out = mul(out, z[None, :])
        out = out + monic[:, i][:, None]
        out = np.where(out >= _P, out - _P, out)
    return out


# Polynomials as lists of integers, lowest coefficient first.


def _rest(a: list[int], f: list[int]) -> list[int]:
    a, n = a[:], len(f) - 1
    for i in range(len(a) - 1, n - 1, -1):
        if q := a[i]:
            for j in range(n):
                a[i - n + j] = (a[i - n + j] - q * f[j]) % P
    return _trim(a[:n])


def _trim(a: list[int]) -> list[int]:
    while a and not a[-1]:
        a.pop()
    return a


def _times(a: list[int], b: list[int], f: list[int]) -> list[int]:
    out = [0] * max(0, len(a) + len(b) - 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] += x * y
    return _rest([x % P for x in out], f)


def _raise(a: list[int], n: int, f: list[int]) -> list[int]:
    out = [1]
    for bit in bin(n)[2:]:
        out = _times(out, out, f)
        if bit == "1":
            out = _times(out, a, f)
    return out


def _monic(a: list[int]) -> list[int]:
    i = pow(a[-1], -1, P)
    return [x * i % P for x in a]


def _common(a: list[int], b: list[int]) -> list[int]:
    while b:
        b = _monic(b)
        a, b = b, _rest(a, b)
    return _monic(a)


def _divide(a: list[int], f: list[int]) -> list[int]:
    a, n = a[:], len(f) - 1
    out = [0] * (len(a) - n)
    for i in range(len(a) - 1, n - 1, -1):
        q = out[i - n] = a[i]
        for j in range(n + 1):
            a[i - n + j] = (a[i - n + j] - q * f[j]) % P
    return out


def roots(f: list[int]) -> list[int] | None:
    """All roots of a monic polynomial, or None if it isn't a product of different linear factors."""
    if len(f) == 1:
        return []
    if len(f) == 2:
        return [-f[0] % P]
    if len(f) == 3:
        half = f[1] * pow(2, -1, P) % P
        square = (half * half - f[0]) % P
        s = pow(square, (P + 1) // 4, P)
        return None if not square or s * s % P != square else [(s - half) % P, (-s - half) % P]
    if _raise([0, 1], P, f) != [0, 1]:
        return None
    found, open_, shift = [], [f], 1
    while open_:
        g = open_.pop()
        if len(g) <= 3:
            found += roots(g) or []
            continue
        while True:  # x + shift is a square for about half of the roots
            shift += 1
            h = _raise([shift, 1], (P - 1) // 2, g)
            h = _trim([((h[0] if h else 0) - 1) % P, *h[1:]])
            if h and 1 < len(part := _common(g, h)) < len(g):
                open_ += [part, _divide(g, part)]
                break
    return found
