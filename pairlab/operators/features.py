"""Feature vectors built from pooled chain embeddings (all JVM-side array expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions import vectors as V


def concat_features(df: DataFrame, h: str = "h", l: str = "l", ag: str = "ag", out: str = "x") -> DataFrame:
    """[H | L | Ag] concatenation (3 * dim)."""
    return df.withColumn(out, V.concat_vectors(h, l, ag))


def antibody_vector(df: DataFrame, h: str = "h", l: str = "l", out: str = "ab") -> DataFrame:
    """(H+L)/2 if the light block has a non-zero element, else H; ``has_light`` flag."""
    return (df.withColumn("has_light", V.has_nonzero(l))
              .withColumn(out, V.antibody(h, l)))


def interaction_features(df: DataFrame, h: str = "h", l: str = "l", ag: str = "ag",
                         packed: bool = False) -> DataFrame:
    """Antibody-antigen interaction: hadamard (dim), |ab-ag| (dim), cosine (1).

    ``packed=True`` also returns ``x_int`` = hadamard ++ abs_diff ++ [cosine] (2*dim+1).
    """
    out = antibody_vector(df, h, l, "ab")
    out = (out.withColumn("hadamard", V.vmul("ab", ag))
              .withColumn("abs_diff", V.vabs_diff("ab", ag))
              .withColumn("cosine", V.cosine("ab", ag)))
    if packed:
        out = out.withColumn("x_int", F.concat("hadamard", "abs_diff", F.array("cosine")))
    return out


def feature_block(df: DataFrame, x: str = "x", x_int: str = "x_int", out: str = "x_all") -> DataFrame:
    """concat features ++ interaction features (3*dim + 2*dim + 1)."""
    return df.withColumn(out, F.concat(x, x_int))


def salience(df: DataFrame, hadamard: str = "hadamard", out: str = "salience") -> DataFrame:
    """L2 norm of the hadamard block, the per-candidate salience magnitude."""
    return df.withColumn(out, V.l2norm(hadamard))


def component_views(df: DataFrame, dim: int, x: str = "x") -> DataFrame:
    """Antigen-only block and heavy+light block of a concatenated vector."""
    return (df.withColumn("x_antigen", V.block(x, 2, dim))
              .withColumn("x_antibody", F.slice(x, 1, 2 * dim)))
