"""Distances between vectors as column expressions.

Products are of doubles and are summed in order in double precision; the result is one float.
Everything is a built-in expression, so it stays in the JVM and equals the Arrow kernels of
``quillon.operators.knn`` bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm64(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def norm(v: Column) -> Column:
    """Euclidean norm, as a float."""
    return norm64(v).cast("float")


def dot_product(a: Column, b: Column) -> Column:
    """A similarity: ordered ascending it lists the least alike first."""
    return _dot(a, b).cast("float")


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance, with the square root."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))).cast("float")


def cosine_from(product: Column, a_norm: Column, b_norm: Column) -> Column:
    """Cosine distance of vectors whose dot product and norms are known; 1 if a norm is 0."""
    return F.when((a_norm == 0) | (b_norm == 0), F.lit(1.0)).otherwise(1 - product / (a_norm * b_norm)).cast("float")


def cosine_distance(a: Column, b: Column) -> Column:
    return cosine_from(_dot(a, b), norm64(a), norm64(b))


def cosine_distance_cached(a: Column, b: Column, a_norm: Column, b_norm: Column) -> Column:
    """With norms kept as floats next to the vectors: equal to the above within 1e-6."""
    return cosine_from(_dot(a, b), a_norm.cast("double"), b_norm.cast("double"))


METRICS: dict[str, Metric] = {"cosine": cosine_distance, "l2": l2_distance, "dot": dot_product}


def metric_of(metric: str | Metric) -> Metric:
    """A metric by name, or the given expression builder itself."""
    if callable(metric):
        return metric
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return METRICS[metric]


def distances(queries: np.ndarray, corpus: np.ndarray, metric: str) -> np.ndarray:
    """Matrix of distances, summed dimension by dimension as the expressions do."""
    q, c = queries.astype(np.float64), np.ascontiguousarray(corpus.astype(np.float64).T)
    total = np.zeros((len(q), c.shape[1]))
    term = np.empty_like(total)
    for d in range(q.shape[1]):
        if metric == "l2":
            np.subtract(q[:, d, None], c[d], out=term)
            np.multiply(term, term, out=term)
        else:
            np.multiply(q[:, d, None], c[d], out=term)
        total += term
    if metric == "dot":
        return total.astype(np.float32)
    if metric == "l2":
        return np.sqrt(total).astype(np.float32)
    qn, cn = norms(queries), norms(corpus)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 1 - total / (qn[:, None] * cn)
    out[(qn == 0)[:, None] | (cn == 0)] = 1.0
    return out.astype(np.float32)


def norms(vectors: np.ndarray) -> np.ndarray:
    """Norms in double precision, summed in order."""
    v = vectors.astype(np.float64)
    total = np.zeros(len(v))
    for d in range(v.shape[1]):
        total += v[:, d] * v[:, d]
    return np.sqrt(total)
