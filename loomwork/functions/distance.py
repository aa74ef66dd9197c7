"""Vector kernels over ``array<double>`` columns, and the same measures over numpy rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def dot(a: Column, b: Column) -> Column:
    return total(hadamard(a, b))


def asum(v: Column) -> Column:
    return total(F.transform(v, lambda x: F.abs(x)))


def axpy(alpha: float, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: alpha * a + b)


def scal(alpha: float, v: Column) -> Column:
    return F.transform(v, lambda x: alpha * x)


def norm(v: Column, p: float = 2.0) -> Column:
    if p == 1.0:
        return asum(v)
    if p == 2.0:
        return F.sqrt(total(F.transform(v, lambda x: x * x)))
    if p == float("inf"):
        return F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.pow(total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(p)))), F.lit(1.0 / p))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    """One minus the cosine; null where a vector is zero and an error is wanted by the caller."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, 1 - dot(a, b) / scale)


def distance(measure: str, a: Column, b: Column) -> Column:
    return {"euclidean": euclidean, "manhattan": manhattan, "cosine": cosine}[measure](a, b)


def pairwise(measure: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of every row of ``x`` to every row of ``y``, in blocks that keep memory small."""
    if measure == "cosine":
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        if (nx == 0).any() or (ny == 0).any():
            raise ValueError("the cosine of a zero vector is not defined")
        return 1 - (x @ y.T) / nx[:, None] / ny[None]
    out = np.empty((len(x), len(y)))
    step = max(1, 4_000_000 // max(1, y.size))
    for a in range(0, len(x), step):
        diff = x[a : a + step, None, :] - y[None]
        out[a : a + step] = np.abs(diff).sum(axis=2) if measure == "manhattan" else np.sqrt((diff * diff).sum(axis=2))
    return out
