"""Largest eigenvalues and their vectors of a symmetric integer matrix without negative eigenvalues, exactly.

The characteristic polynomial is found modulo many primes (reduction to Hessenberg form) and put
together by Chinese remaindering. All its roots are real, so the sign changes of its coefficients moved to a
count the roots above a; halving intervals by that count isolates each root, and halving by sign refines it.
Vectors come from inverse iteration in fixed-point arithmetic of Python integers.
"""

from __future__ import annotations

import math
import random
from typing import NamedTuple

import numpy as np

#: Bits of a root, counted from the trace's highest one.
BITS = 256


def primes(count: int) -> list[int]:
    """The largest primes under 2^31."""
    small = [p for p in range(2, 46341) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    found, top = [], 1 << 31
    while len(found) < count:
        low = top - (1 << 16)
        prime = np.ones(1 << 16, bool)
        for p in small:
            prime[-low % p :: p] = False
        found += [low + int(i) for i in np.flatnonzero(prime)[::-1]]
        top = low
    return found[:count]


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - matrix) modulo p, constant first; entries of matrix are in [0, p), p < 2^31."""
    h, d = matrix.astype(np.int64).copy(), len(matrix)
    for k in range(1, d - 1):
        at = np.flatnonzero(h[k:, k - 1])
        if not len(at):
            continue
        i = k + int(at[0])
        if i != k:
            h[[i, k]] = h[[k, i]]
            h[:, [i, k]] = h[:, [k, i]]
        f = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - f[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * f % p).sum(1)) % p
    rows = np.zeros((d + 1, d + 1), np.int64)
    rows[0, 0] = 1
    for k in range(1, d + 1):
        rows[k, 1:] = rows[k - 1, :-1]
        weights, below = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = h[i, k - 1] * below % p
            below = below * int(h[i, i - 1]) % p if i else 0
        rows[k] = (rows[k] - (weights[:, None] * rows[:k] % p).sum(0)) % p
    return [int(x) for x in rows[d]]


def n_primes(d: int, trace: int) -> int:
    """So many that their product is over twice any coefficient: the k-th elementary sum of d values is at most C(d, k) (trace / d)^k."""
    most = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    return (2 * most).bit_length() // 30 + 1


def combined(residues: dict[int, list[int]]) -> list[int]:
    """The integers, nearest to 0, that leave these residues."""
    whole = math.prod(residues)
    out = [0] * len(next(iter(residues.values())))
    for p, values in residues.items():
        rest = whole // p
        unit = rest * pow(rest % p, -1, p)
        out = [x + unit * v for x, v in zip(out, values)]
    out = [x % whole for x in out]
    return [x - whole if 2 * x > whole else x for x in out]


class Root(NamedTuple):
    value: int  #: times 2^bits
    bits: int
    times: int  #: how often it is one


def _above(scaled: list[int], a: int) -> int:
    """Roots above a of a polynomial whose roots are all real, with multiplicity: sign changes after moving it by a."""
    c = list(scaled)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(scaled: list[int], a: int) -> int:
    value = 0
    for c in reversed(scaled):
        value = value * a + c
    return (value > 0) - (value < 0)


def top_roots(coefficients: list[int], count: int, trace: int) -> list[Root]:
    """The largest distinct positive roots, until they are `count` together with multiplicity.

    Roots that agree in all BITS bits count as one.
    """
    d = len(coefficients) - 1
    positive = d - next(i for i, c in enumerate(coefficients) if c)
    bits = max(0, BITS - trace.bit_length())
    scaled = [c << bits * (d - k) for k, c in enumerate(coefficients)]
    out, done, top = [], 0, (trace + 1) << bits
    while done < min(count, positive):
        low, high, n_low, n_high = 0, top, positive, done  # the next root lies in (low, high]; `done` lie above
        while high - low > 1 and n_low - n_high > 1:
            mid = (low + high) // 2
            n = _above(scaled, mid)
            if n > done:
                low, n_low = mid, n
            else:
                high, n_high = mid, n
        while high - low > 1:
            mid = (low + high) // 2
            s = _sign(scaled, mid)
            if s == 0:
                low, high = mid - 1, mid
            elif s == (-1) ** n_high:
                high = mid
            else:
                low = mid
        out.append(Root(high, bits, n_low - n_high))
        done, top = n_low, high - 1
    return out


def _solved(matrix: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """x with matrix x = right, in fixed point of so many bits; a pivot of 0 counts as the least positive number."""
    d = len(matrix)
    a = np.concatenate([matrix, right], 1)
    for k in range(d):
        i = max(range(k, d), key=lambda i: abs(a[i, k]))
        if i != k:
            a[[i, k]] = a[[k, i]]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < d:
            f = (a[k + 1 :, k] << bits) // a[k, k]
            a[k + 1 :, k:] -= (f[:, None] * a[k, k:][None, :]) >> bits
    x = np.empty((d, right.shape[1]), object)
    for k in range(d - 1, -1, -1):
        rest = a[k, d:] - ((a[k, k + 1 : d, None] * x[k + 1 :]).sum(0) >> bits) if k + 1 < d else a[k, d:]
        x[k] = (rest << bits) // a[k, k]
    return x


def _orthonormal(columns: np.ndarray, bits: int) -> np.ndarray:
    out = columns.copy()
    for j in range(out.shape[1]):
        for _ in range(2):
            top = max(abs(v) for v in out[:, j]) or 1
            out[:, j] = (out[:, j] << bits) // top
            for i in range(j):
                along = (out[:, i] * out[:, j]).sum() >> bits
                out[:, j] -= (out[:, i] * along) >> bits
        length = math.isqrt(int((out[:, j] * out[:, j]).sum())) or 1
        out[:, j] = (out[:, j] << bits) // length
    return out


def vectors(matrix: np.ndarray, root: Root, count: int) -> list[list[float]]:
    """Up to `count` orthonormal vectors for the root, as doubles; the largest entry (the first of equals) is positive."""
    d, bits = len(matrix), 2 * BITS
    shifted = np.array([[int(v) << root.bits for v in row] for row in matrix], object)
    for i in range(d):
        shifted[i, i] -= root.value
    draw = random.Random(d)
    x = np.array([[draw.getrandbits(bits) for _ in range(min(count, root.times))] for _ in range(d)], object)
    for _ in range(2):
        x = _orthonormal(_solved(shifted, x, bits), bits)
    out = []
    for column in x.T:
        top = max(column, key=abs)
        out.append([float(v if top > 0 else -v) / 2.0**bits for v in column])
    return out
