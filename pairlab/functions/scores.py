"""Scalar score functions: sigmoid, entropies, losses, decisions, hashing for sampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlab.functions.vectors import col_of

__all__ = ["sigmoid", "binary_entropy", "class_entropy", "bce_with_logits", "decision",
           "weighted_score", "tie_key", "draw_key"]

# fixed values: epsilon inside the entropy logarithms, decision threshold, tie precision
LOG_EPS = 1e-10
THRESHOLD = 0.5
TIE_DIGITS = 12


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_of(z)))


def binary_entropy(p) -> Column:
    p = col_of(p)
    return -(p * F.log(p + F.lit(LOG_EPS)) + (F.lit(1.0) - p) * F.log(F.lit(1.0) - p + F.lit(LOG_EPS)))


def class_entropy(probs) -> Column:
    """-sum p_k ln(p_k + eps) over a probability array."""
    return -F.aggregate(col_of(probs), F.lit(0.0).cast("double"),
                        lambda acc, p: acc + p * F.log(p + F.lit(LOG_EPS)))


def bce_with_logits(z, y, pos_weight=1.0) -> Column:
    """Numerically stable BCE on logits with a positive-class weight.

    loss = pw*y*softplus(-z) + (1-y)*softplus(z), softplus(t) = max(t,0) + ln(1+exp(-|t|)).
    """
    z, y = col_of(z), col_of(y).cast("double")
    pw = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))

    def softplus(t):
        return F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))

    return pw * y * softplus(-z) + (F.lit(1.0) - y) * softplus(z)


def decision(p, threshold: float = THRESHOLD) -> Column:
    return (col_of(p) >= F.lit(threshold)).cast("int")


def weighted_score(ent, z, w: float) -> Column:
    """Entropy nudged by salience: ent * (1 + w * tanh(z))."""
    return col_of(ent) * (F.lit(1.0) + F.lit(w) * F.tanh(col_of(z)))


def tie_key(score) -> Column:
    """Score rounded so that engine-level float noise cannot reorder equal scores."""
    return F.round(col_of(score), TIE_DIGITS)


def draw_key(row_id, *salt) -> Column:
    """Deterministic pseudo-random order: md5 of 'salt1:salt2:...:row_id'.

    Depends only on the row, never on partitioning or row order, so every draw is
    reproducible after task retries and identical across engines.
    """
    parts = [F.lit(str(s)) if not isinstance(s, Column) else s.cast("string") for s in salt]
    return F.md5(F.concat_ws(":", *parts, col_of(row_id).cast("string")))
