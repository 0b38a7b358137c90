"""Shingle sets and tensored MinHash signatures of texts, in numpy."""

from __future__ import annotations

import numpy as np

from .kernels import U64, SpanHasher, blocks, mix64, token_bounds

#: Bytes that separate words: space and the controls 9 to 13.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Shingler:
    """Sets of hashed word shingles, and a few numbers per set."""

    def __init__(self, width: int, rows: int, size: int, seed: int):
        self.width, self.rows, self.size = width, rows, size
        self.hash = SpanHasher()
        rng = np.random.default_rng(seed)
        self.mult = rng.integers(0, 1 << 63, 2 * rows * size, dtype=np.uint64) * U64(2) + U64(1)
        self.add = rng.integers(0, 1 << 63, 2 * rows * size, dtype=np.uint64)

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text; empty without words."""
        out: list[np.ndarray] = []
        data = [t or b"" for t in texts]
        for lo, hi in blocks([len(t) for t in data]):
            out += self._block(data[lo:hi])
        return out

    def _block(self, data: list[bytes]) -> list[np.ndarray]:
        joined = _LOWER[np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)]
        start, end = token_bounds(~_SPACE[joined])
        word = self.hash(joined, start, end)
        limit = np.cumsum([len(t) + 1 for t in data])
        first = np.searchsorted(start, np.concatenate(([0], limit[:-1])))
        last = np.searchsorted(start, limit)
        with np.errstate(over="ignore"):
            n, w = len(word), self.width
            whole = np.zeros(n, dtype=U64)
            for k in range(min(w, n)):
                whole[: n - k] = mix64(whole[: n - k] + word[k:] * U64(2 * k + 3))
        out = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= w:
                out.append(np.unique(whole[a : b - w + 1]))
            elif b > a:
                with np.errstate(over="ignore"):
                    h = np.array([b - a], dtype=U64)
                    for x in word[a:b]:
                        h = mix64(h * U64(31) + x)
                out.append(h)
            else:
                out.append(np.zeros(0, dtype=U64))
        return out

    def identity(self, one: np.ndarray) -> int:
        """A signed 64-bit name of a whole set."""
        with np.errstate(over="ignore"):
            total = np.add.reduce(mix64(one + U64(0x5851F42D4C957F2D))) + U64(len(one))
            return int(mix64(np.array([total], dtype=U64)).view(np.int64)[0])

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """Two small collections of sub-signatures per non-empty set: shape (sets, 2 * size), signed.

        Column c folds ``rows`` minhashes.  A table key pairs a column of the
        first half with one of the second, so size**2 tables cost only
        2 * size * rows minhashes.
        """
        flat = np.concatenate(sets) if sets else np.zeros(0, dtype=U64)
        at = np.cumsum([0] + [len(s) for s in sets])[:-1]
        out = np.zeros((len(sets), 2 * self.size), dtype=U64)
        if len(flat):
            with np.errstate(over="ignore"):
                for c in range(2 * self.size):
                    for r in range(self.rows):
                        k = c * self.rows + r
                        least = np.minimum.reduceat((flat ^ self.add[k]) * self.mult[k] >> U64(1), at)
                        out[:, c] = mix64(out[:, c] * U64(0x9E3779B97F4A7C15) + least)
        return out.view(np.int64)
