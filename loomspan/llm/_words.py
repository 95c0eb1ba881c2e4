"""Vectorised words and substring hashes over the bytes of many texts at once.

A polynomial over 64-bit wrap-around arithmetic gives the hash of any substring
from two prefix sums: ``(acc[end] - acc[start]) * base ** -start``. The base is
odd, so that its powers have inverses.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
LENGTH = U(0xD6E8FEB86659FD93)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's last steps)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i for i up to n at least."""
    for key, base in (("up", BASE), ("down", INVERSE)):
        if len(_powers[key]) <= n:
            out = np.full(max(n + 1, 1 << 16), base, U)
            out[0] = 1
            with np.errstate(over="ignore"):
                _powers[key] = np.cumprod(out, dtype=U)
    return _powers["up"], _powers["down"]


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PLAIN = stream(256, 11)
LOWER = PLAIN.copy()
LOWER[ord("A") : ord("Z") + 1] = PLAIN[ord("a") : ord("z") + 1]
ORDER = stream(64, 29) | U(1)


class Prefix:
    """Prefix sums over symbols; gives the hashes of substrings."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = powers(len(symbols))
        self.acc = np.zeros(len(symbols) + 1, U)
        np.cumsum(symbols * up[: len(symbols)], out=self.acc[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.acc[end] - self.acc[start]) * self.down[start]
        return mix(raw + (end - start).astype(U) * LENGTH)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes outside [\\x20\\x09-\\x0D]."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    begins, ends = off[:-1][full], off[1:][full] - 1
    first[begins] = inside[begins]
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off[1:], start, side="right")


def windows(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k consecutive words of one row; index of each window's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(n, U)
    for j in range(k):
        total += hashes[j : j + n] * ORDER[j]
    at = np.flatnonzero(row[:n] == row[k - 1 : k - 1 + n])
    return mix(total[at] + U(k)), at


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles (A-Z lower-cased) of each row as sorted 64-bit hashes, rows one after
    the other, with row offsets. Rows of fewer words have one shingle of all of them; rows without words none."""
    start, end, row = words(data, off)
    hashes = Prefix(LOWER[data]).hashes(start, end)
    grams, at = windows(hashes, row, k)
    owner = row[at]
    count = np.bincount(row, minlength=len(off) - 1)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    small, owners = [grams], [owner]
    for n in range(1, k):
        rows = np.flatnonzero(count == n)
        total = np.zeros(len(rows), U)
        for j in range(n):
            total += hashes[begin[rows] + j] * ORDER[j]
        small.append(mix(total + U(n)))
        owners.append(rows)
    grams, owner = np.concatenate(small), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    grams, owner = grams[order], owner[order]
    edge = np.searchsorted(owner, np.arange(len(off)))
    for a, b in zip(edge[:-1], edge[1:]):
        grams[a:b].sort()
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    sizes = np.bincount(owner[keep], minlength=len(off) - 1)
    return grams[keep], np.concatenate([[0], np.cumsum(sizes)])
