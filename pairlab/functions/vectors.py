"""Dense-vector arithmetic on ARRAY<DOUBLE> columns with SQL higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["col_of", "vsum", "dot", "sumsq", "l2norm", "vadd", "vmul",
           "vscale", "vabs_diff", "vmean2", "zeros", "has_nonzero", "antibody", "cosine",
           "block", "concat_vectors", "euclidean"]

# fixed values: the epsilon added to each norm before the cosine division
NORM_EPS = 1e-10


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vsum(c) -> Column:
    return F.aggregate(col_of(c), F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return vsum(F.zip_with(col_of(a), col_of(b), lambda x, y: x * y))


def sumsq(a) -> Column:
    return F.aggregate(col_of(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def l2norm(a) -> Column:
    return F.sqrt(sumsq(a))


def vadd(a, b) -> Column:
    return F.zip_with(col_of(a), col_of(b), lambda x, y: x + y)


def vmul(a, b) -> Column:
    """Hadamard (element-wise) product."""
    return F.zip_with(col_of(a), col_of(b), lambda x, y: x * y)


def vscale(a, s) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(col_of(a), lambda x: x * s)


def vabs_diff(a, b) -> Column:
    return F.zip_with(col_of(a), col_of(b), lambda x, y: F.abs(x - y))


def vmean2(a, b) -> Column:
    return F.zip_with(col_of(a), col_of(b), lambda x, y: (x + y) / 2.0)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("double"), dim)


def has_nonzero(a) -> Column:
    """True when any element differs from 0; NULL/empty vectors count as absent (false)."""
    return F.coalesce(F.exists(col_of(a), lambda x: x != 0), F.lit(False))


def antibody(heavy, light) -> Column:
    """(H+L)/2 when the light vector has any non-zero element, otherwise H."""
    return F.when(has_nonzero(light), vmean2(heavy, light)).otherwise(col_of(heavy))


def cosine(a, b, eps: float = NORM_EPS) -> Column:
    """dot / ((|a|+eps) * (|b|+eps)); the epsilon is added to each norm separately."""
    return dot(a, b) / ((l2norm(a) + F.lit(eps)) * (l2norm(b) + F.lit(eps)))


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col_of(a), col_of(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def block(x, k: int, dim: int) -> Column:
    """The k-th dim-wide block of a concatenated vector (0-based k)."""
    return F.slice(col_of(x), k * dim + 1, dim)


def concat_vectors(*cols) -> Column:
    return F.concat(*[col_of(c) for c in cols])
