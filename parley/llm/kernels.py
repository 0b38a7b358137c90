"""Vectorised text kernels shared by the corpus operators.

Everything here is pure numpy over the UTF-8 bytes or code points of a bounded
block of texts; nothing touches Spark.  Hashes are fixed functions of their
input, so any executor, retry or rerun gets the same values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
#: Texts are processed in blocks of about this many bytes.
BLOCK_BYTES = 4 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=U64)
    have, top = 1, base % (1 << 64)
    with np.errstate(over="ignore"):
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more] * U64(top)
            have += more
            top = top * top % (1 << 64)
    return out[:n]


class SpanHasher:
    """64-bit hashes of byte spans of one buffer, by prefix sums."""

    def __init__(self, size: int = 1 << 16):
        self._up = powers(_R, size)
        self._down = powers(_R_INV, size)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        if n + 1 > len(self._up):
            size = max(n + 1, 2 * len(self._up))
            self._up, self._down = powers(_R, size), powers(_R_INV, size)
        with np.errstate(over="ignore"):
            prefix = np.zeros(n + 1, dtype=U64)
            np.cumsum((data.astype(U64) + U64(1)) * self._up[:n], out=prefix[1:])
            value = (prefix[end] - prefix[start]) * self._down[start]
            return mix64(value + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


class CharTable:
    """A small number per code point, worked out when a code point first occurs.  ``of`` must stay under 255."""

    def __init__(self, of: Callable[[str], int]):
        self.of = of
        self.table = np.full(0x110000, 255, dtype=np.uint8)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        kind = self.table[code]
        new = kind == 255
        if new.any():
            for c in np.unique(code[new]).tolist():
                self.table[c] = self.of(chr(c))
            kind = self.table[code]
        return kind


def blocks(sizes: list[int], limit: int = BLOCK_BYTES):
    """Index ranges of consecutive texts that together hold about ``limit`` bytes.

    A text longer than the limit stands alone; no text is cut.
    """
    first = total = 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def token_bounds(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in a boolean array."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return edge[0::2], edge[1::2]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Connected components of a small graph: (nodes, smallest node of each one's component)."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[a], low[b])
        was = low.copy()
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        np.minimum.at(low, was, low)
        low = low[low]
        if np.array_equal(low, was):
            return nodes, nodes[low]
