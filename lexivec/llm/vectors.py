"""Vectors as whole numbers: what clustering and search share."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest long; components and results beyond it are cut to it, on both sides.
LONG = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and has no null, NaN or infinite component."""
    def good(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

    return F.coalesce(F.forall(vector.cast("array<double>"), good), F.lit(False))


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each x, as a double, cut to the range of a long."""
    with np.errstate(over="ignore"):
        x = np.floor(np.asarray(values, np.float64) * scale)
    if not x.size or np.abs(x).max() < 2.0**63:
        return x.astype(np.int64)
    inside = np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64)
    return np.where(x >= 2.0**63, LONG, np.where(x <= -(2.0**63), -LONG, inside))


def tight(numbers: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest of 2, 4 and 8 bytes."""
    most = int(max(numbers.max(), -int(numbers.min()))) if numbers.size else 0
    return numbers.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def rows(cells: Iterable[bytes], width: int) -> np.ndarray:
    """A matrix of `width` columns from the bytes of its rows, each as tight() has them."""
    cells = list(cells)
    if not width or not cells:
        return np.zeros((len(cells), width), np.int64)
    sizes = {len(c) for c in cells}
    if len(sizes) == 1:
        return np.frombuffer(b"".join(cells), f"<i{sizes.pop() // width}").reshape(-1, width).astype(np.int64)
    return np.stack([np.frombuffer(c, f"<i{len(c) // width}").astype(np.int64) for c in cells])


def largest(numbers: np.ndarray) -> int:
    return max(int(numbers.max()), -int(numbers.min())) if numbers.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact a @ b.T of whole numbers, cut to the range of a long: in floating point where that is exact, else in longs
    or in numbers of any size."""
    most = largest(a) * largest(b) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most <= LONG:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -LONG, LONG).astype(np.int64)
