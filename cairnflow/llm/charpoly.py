"""Eigenvalues and eigenvectors of symmetric integer matrices by their exact characteristic polynomial.

The polynomial is found modulo many primes, from a Hessenberg form of the matrix, and put together by Chinese remainders.
As all its roots are real, the signs of its coefficients moved to a point count the roots beyond that point exactly, so
roots are isolated, with their multiplicities, by bisection, and then narrowed down. A vector of the null space of the
matrix less a root comes from inverse iteration in whole numbers of some hundred bits."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

ROOT_BITS = 192
"""Roots are found to this many bits below the trace; roots that are no further apart count as one, several times."""
WORK_BITS = ROOT_BITS + 128


def primes() -> Iterator[int]:
    """Primes below 2^31, from the largest on."""
    p = (1 << 31) - 1
    while p > 2:
        if _is_prime(p):
            yield p
        p -= 2


def _is_prime(p: int) -> bool:
    """Miller and Rabin's test, exact for 32 bits with these bases."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, p)
        if x in (1, p - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % p
            if x == p - 1:
                break
        else:
            return False
    return True


def enough_primes(trace: int, size: int) -> list[int]:
    """As many as the coefficients need: those of a matrix without negative roots are at most C(size, k) (trace/size)^k."""
    most = max(math.comb(size, k) * -(-(trace**k) // size**k) for k in range(size + 1))
    out, product = [], 1
    for p in primes():
        if product > 2 * most:
            return out
        out.append(p)
        product *= p
    raise OverflowError("the matrix needs more primes than there are below 2^31")


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, lowest first, of the characteristic polynomial modulo p. matrix: whole numbers of any size."""
    h = (matrix % p).astype(np.int64)
    n = len(h)
    for j in range(n - 2):
        found = np.flatnonzero(h[j + 1 :, j])
        if not len(found):
            continue
        i = j + 1 + found[0]
        if i != j + 1:
            h[[i, j + 1]] = h[[j + 1, i]]
            h[:, [i, j + 1]] = h[:, [j + 1, i]]
        u = h[j + 2 :, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2 :] = (h[j + 2 :] - u[:, None] * h[j + 1] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2 :] * u % p).sum(1)) % p
    known = np.zeros((n + 1, n + 1), np.int64)  # row k: the polynomial of the leading k rows and columns
    known[0, 0] = 1
    for k in range(1, n + 1):
        weights, product = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * product % p
            product = product * int(h[i, i - 1]) % p if i else product
        known[k, 1:] = known[k - 1, :-1]
        known[k] = (known[k] - (weights[:, None] * known[:k] % p).sum(0)) % p
    return known[n].tolist()


def combined(residues: Sequence[Sequence[int]], moduli: Sequence[int]) -> list[int]:
    """The whole numbers, of either sign, with these residues."""
    product = math.prod(moduli)
    parts = [(product // p) * pow(product // p, -1, p) for p in moduli]
    sums = (sum(part * r[k] for part, r in zip(parts, residues, strict=True)) % product for k in range(len(residues[0])))
    return [v - product if v > product // 2 else v for v in sums]


def _moved(poly: list[int], by: int) -> list[int]:
    out = list(poly)
    for i in range(len(out) - 1):
        for k in range(len(out) - 2, i - 1, -1):
            out[k] += by * out[k + 1]
    return out


def beyond(poly: list[int], at: int) -> int:
    """How many roots are larger than a whole number; every root has to be real."""
    signs = [c > 0 for c in _moved(poly, at) if c]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], at: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * at + c
    return out


class Roots:
    """The largest roots of a polynomial whose roots are real and not negative, as numerators over 2^shift."""

    def __init__(self, poly: list[int], bound: int, most: int, bits: int = ROOT_BITS):
        """bound: no root is larger. most: how many roots are wanted, with multiplicities; roots of zero are not counted."""
        zeros = next(i for i, c in enumerate(poly) if c)
        poly = poly[zeros:]
        self.rank = len(poly) - 1
        self.shift = max(0, bits - bound.bit_length())
        self._poly = [c << self.shift * (self.rank - k) for k, c in enumerate(poly)]
        self._unit = 1 << max(0, bound.bit_length() - bits)
        self.found: list[tuple[int, int]] = []
        """Numerator and multiplicity, from the largest on."""
        self._search(0, (bound << self.shift) + 1, self.rank, 0, most)

    def _search(self, low: int, high: int, above_low: int, above_high: int, most: int) -> None:
        """low < roots <= high."""
        here = above_low - above_high
        if not here or above_high >= most:
            return
        if high - low <= self._unit:
            self.found.append((high, here))
            return
        if here == 1:
            self.found.append((self._narrowed(low, high), 1))
            return
        middle = (low + high) // 2
        above = beyond(self._poly, middle)
        self._search(middle, high, above, above_high, most)
        self._search(low, middle, above_low, above, most)

    def _narrowed(self, low: int, high: int) -> int:
        at_high = _value(self._poly, high)
        while at_high and high - low > self._unit:
            middle = (low + high) // 2
            value = _value(self._poly, middle)
            if value == 0:
                return middle
            if (value > 0) == (at_high > 0):
                high, at_high = middle, value
            else:
                low = middle
        return high


def null_vectors(matrix: np.ndarray, root: int, shift: int, many: int, rounds: int = 4) -> np.ndarray:
    """Orthonormal vectors (many x size, doubles) of the null space of the matrix less root / 2^shift."""
    n = len(matrix)
    scale = max(1, max(abs(int(v)) for v in matrix.ravel()))
    one = 1 << WORK_BITS
    less = matrix.astype(object) << WORK_BITS
    less[np.arange(n), np.arange(n)] -= (root << WORK_BITS) >> shift
    less //= scale
    order, factors = [], []
    for j in range(n):  # factors of the rows, with the largest pivots
        pivot = j + max(range(n - j), key=lambda i: abs(less[j + i, j]))
        order.append(pivot)
        if pivot != j:
            less[[j, pivot]] = less[[pivot, j]]
        if less[j, j] == 0:
            less[j, j] = 1
        f = (less[j + 1 :, j] << WORK_BITS) // less[j, j]
        factors.append(f)
        if len(f):
            less[j + 1 :, j:] -= (f[:, None] * less[j, j:]) >> WORK_BITS
    state, start = 1, np.empty((many, n), object)
    for v in range(many):
        for i in range(n):
            state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            start[v, i] = (state - (1 << 63)) << (WORK_BITS - 64)
    vectors = start
    for _ in range(rounds):
        solved = []
        for v in vectors:
            x = v.copy()
            for j in range(n):
                x[[j, order[j]]] = x[[order[j], j]]
                x[j + 1 :] -= (factors[j] * x[j]) >> WORK_BITS
            for j in range(n - 1, -1, -1):
                x[j] = ((x[j] - ((less[j, j + 1 :] * x[j + 1 :]).sum() >> WORK_BITS if j + 1 < n else 0)) << WORK_BITS) // less[j, j]
            solved.append(x)
        vectors = _orthonormal(solved, one)
    return np.array([[int(c) / one for c in v] for v in vectors])


def _orthonormal(vectors: list[np.ndarray], one: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for v in vectors:
        v = (v << WORK_BITS) // max(1, max(abs(int(c)) for c in v))
        for _ in range(2):
            for u in out:
                v = v - ((((u * v).sum() >> WORK_BITS) * u) >> WORK_BITS)
        length = math.isqrt(int((v * v).sum()))
        out.append((v << WORK_BITS) // max(1, length))
    return out
