"""Distances of vector columns in double precision, smaller is nearer, as column expressions and as numpy kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

METRICS = ("l2", "cosine", "ip")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Squared L2, negative cosine, or negative inner product of two array columns."""
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric == "cosine":
        return -_dot(a, b) / F.greatest(F.lit(1e-12), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    if metric == "ip":
        return -_dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def matrix(q: np.ndarray, v: np.ndarray, metric: str = "l2") -> np.ndarray:
    """Distances of all rows of q to all rows of v, by one matrix product."""
    product = q @ v.T
    if metric == "l2":
        return np.maximum((q * q).sum(1)[:, None] - 2 * product + (v * v).sum(1)[None], 0)
    if metric == "cosine":
        return -product / np.maximum(1e-12, np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None])
    if metric == "ip":
        return -product
    raise ValueError(f"unknown metric {metric!r}")


def normalised(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.sqrt(_dot(v, v) + F.lit(1e-10)))
