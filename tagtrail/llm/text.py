"""Texts as NumPy arrays of code points: tokens, hashes and n-grams without a loop per character."""

from __future__ import annotations

from functools import cache

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x100000001B3  # odd, so that it has an inverse modulo 2**64
_BLOCK = 1 << 14


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@cache
def _table(kind: str) -> np.ndarray:
    test = {"word": str.isalnum, "letter": str.isalpha, "space": str.isspace}[kind]
    return np.fromiter((test(chr(c)) for c in range(0x110000)), dtype=bool, count=0x110000)


def is_kind(points: np.ndarray, kind: str) -> np.ndarray:
    return _table(kind)[points]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit word over all others (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


@cache
def _powers(blocks: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        head = np.empty(_BLOCK, np.uint64)
        x = 1
        for i in range(_BLOCK):
            head[i] = x
            x = x * base % 2 ** 64
        steps = [pow(base, _BLOCK * i, 2 ** 64) for i in range(blocks)]
        return (np.array(steps, np.uint64)[:, None] * head[None, :]).ravel()
    return powers(BASE), powers(pow(BASE, -1, 2 ** 64))


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of an array of code points; equal spans have equal
    hashes wherever they stand."""
    blocks = 1
    while blocks * _BLOCK <= len(points):
        blocks *= 2
    up, down = _powers(blocks)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:len(points)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * ODD)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def words(text: str) -> np.ndarray:
    """Hashes of the maximal runs of letters and digits of the lower-cased text, in order."""
    points = codes(text.lower())
    starts, ends = runs(is_kind(points, "word"))
    return span_hashes(points, starts, ends)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h = h * ODD + hashes[i:i + count]
    return mix(h)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles. A text of fewer words has one shingle, all
    its words; a text without words has none."""
    w = words(text or "")
    if not len(w):
        return np.empty(0, np.uint64)
    return np.unique(ngrams(w, min(n, len(w))))
