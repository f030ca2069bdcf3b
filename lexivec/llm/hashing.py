"""Hashes of byte ranges, for many ranges of a text at once, in pieces so that memory stays near the size of the text."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Bytes of a text that are hashed at once; a single range that is longer is hashed by itself.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[U64(1), np.full(n - 1, base, U64)], dtype=U64)


class RangeHasher:
    """64-bit polynomial hashes of data[start:end] for sorted ranges that do not overlap; equal bytes hash alike anywhere."""

    def __init__(self, seed: int, fold: bool = False):
        self.bytes = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U64)
        if fold:
            self.bytes[65:91] = self.bytes[97:123]
        self.inverse = pow(_BASE, -1, 1 << 64)
        self.up, self.down = _powers(_BASE, PIECE + 1), _powers(self.inverse, PIECE + 1)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), U64)
        i = 0
        while i < len(starts):
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            piece = data[base : int(ends[j - 1])]
            up, down = (self.up, self.down) if len(piece) <= PIECE else (_powers(_BASE, len(piece) + 1), _powers(self.inverse, len(piece) + 1))
            sums = np.r_[U64(0), np.cumsum(self.bytes[piece] * up[: len(piece)], dtype=U64)]
            s = starts[i:j] - base
            out[i:j] = (sums[ends[i:j] - base] - sums[s]) * down[s]
            i = j
        return mixed(out)


def runs(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the longest runs of bytes that the table `inside` marks."""
    starts, ends, open_at = [], [], False
    for at in range(0, len(data), PIECE):
        here = inside[data[at : at + PIECE]]
        edges = np.flatnonzero(np.diff(here, prepend=open_at)) + at
        (ends if open_at else starts).append(edges[::2])
        (starts if open_at else ends).append(edges[1::2])
        open_at = bool(here[-1])
    if open_at:
        ends.append(np.array([len(data)]))
    none = np.zeros(0, np.int64)
    return (np.concatenate(starts) if starts else none), (np.concatenate(ends) if ends else none)


def grams(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The hash of each run of len(places) hashes, in order."""
    n = max(0, len(hashes) - len(places) + 1)
    out = np.zeros(n, U64)
    for i, p in enumerate(places):
        out += hashes[i : n + i] * p
    return mixed(out + U64(len(places)))
