"""Per-residue (token) embeddings: decode, pool, pad/mask, concatenate, attention pooling.

Token matrices are ARRAY<ARRAY<DOUBLE>> (L x D) per sequence; L is a sequence length, so
each row is bounded by the longest sequence, not by the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.functions import vectors as V


def decode_tokens(df: DataFrame, dim: int | None = None, data: str = "data", shape: str = "shape",
                  out: str = "tokens", wide: bool = True) -> DataFrame:
    """Flat floats -> L x D. D comes from ``shape[1]`` when present, else ``dim``. Without ``wide`` floats stay floats.

    A length that is not a multiple of D fails the task (as a reshape would).
    """
    d = F.coalesce(F.element_at(shape, 2), F.lit(dim)).cast("int") if dim is not None \
        else F.element_at(shape, 2).cast("int")
    n = F.size(data)
    checked = F.when(n % d == 0, n / d).otherwise(
        F.raise_error(F.concat(F.lit("embedding length not a multiple of the width: "), n.cast("string"))))
    ntok = checked.cast("int")
    toks = F.transform(F.sequence(F.lit(0), ntok - 1), lambda i: F.slice(F.col(data), i * d + 1, d))
    kind = "array<array<double>>" if wide else f"array<{df.schema[data].dataType.simpleString()}>"
    return df.withColumn(out, F.when(ntok > 0, toks).otherwise(F.array().cast(kind)))


def _sum_tokens(tokens: Column, dim: Column) -> Column:
    return F.aggregate(tokens, F.array_repeat(F.lit(0.0).cast("double"), dim), lambda acc, t: V.vadd(acc, t))


def mean_pool(df: DataFrame, tokens: str = "tokens", out: str = "pooled") -> DataFrame:
    """(L, D) -> (D): element-wise mean over tokens; NULL for zero tokens."""
    t = F.col(tokens)
    dim = F.size(F.element_at(t, 1))
    s = _sum_tokens(t, dim)
    return df.withColumn(out, F.when(F.size(t) > 0, V.vscale(s, F.lit(1.0) / F.size(t))))


def first_token_pool(df: DataFrame, tokens: str = "tokens", out: str = "cls") -> DataFrame:
    return df.withColumn(out, F.element_at(tokens, 1))


#: Sequences are padded to a multiple of this length, so rows of like length share a shape.
PAD_STEP = 32


def pad_and_mask(df: DataFrame, tokens: str = "tokens", lmax: int | None = None, out: str = "padded",
                 mask: str = "mask") -> DataFrame:
    """Pad every matrix with rows of zeros to the end of its length bucket (the next multiple of PAD_STEP), or to
    ``lmax`` where a model needs one shape; mask marks the real tokens. A long sequence widens no other row."""
    t = F.col(tokens)
    width = F.lit(int(lmax)) if lmax is not None else F.ceil(F.size(t) / PAD_STEP).cast("int") * PAD_STEP
    dim = F.size(F.element_at(t, 1))
    pad = F.array_repeat(F.array_repeat(F.lit(0.0).cast("double"), F.coalesce(dim, F.lit(0))),
                         F.greatest(F.col("_width") - F.size(t), F.lit(0)))
    valid = F.when(F.col("_width") > 0, F.transform(F.sequence(F.lit(1), F.col("_width")), lambda i: i <= F.size(t)))
    return (df.withColumn("_width", width).withColumn(out, F.concat(t, pad))
            .withColumn(mask, F.coalesce(valid, F.array().cast("array<boolean>"))).drop("_width"))


def antibody_tokens(df: DataFrame, heavy: str = "heavy_tokens", light: str = "light_tokens",
                    out: str = "ab_tokens") -> DataFrame:
    """Heavy tokens followed by light tokens (a NULL light chain contributes zero tokens)."""
    empty = F.array().cast("array<array<double>>")
    return df.withColumn(out, F.concat(F.col(heavy), F.coalesce(F.col(light), empty)))


def attention_pool(df: DataFrame, tokens: str, mask: str | None, w, b: float,
                   out: str = "attn_pooled") -> DataFrame:
    """softmax over valid tokens of (t . w + b), then the weighted sum of tokens.

    Invalid tokens get weight 0 (the -inf score); a row with no valid token gives NULL.
    ``w`` is a list of floats or an array column.
    """
    wv = F.array(*[F.lit(float(x)) for x in w]) if isinstance(w, (list, tuple)) else w
    t = F.col(tokens)
    valid = F.col(mask) if mask else F.transform(t, lambda _: F.lit(True))
    d = df.withColumn("_sc", F.zip_with(t, valid, lambda x, ok: F.when(ok, V.dot(x, wv) + F.lit(b))))
    d = d.withColumn("_mx", F.array_max("_sc"))
    d = d.withColumn("_e", F.transform("_sc", lambda s: F.coalesce(F.exp(s - F.col("_mx")), F.lit(0.0))))
    d = d.withColumn("_z", V.vsum("_e"))
    dim = F.size(F.element_at(t, 1))
    acc = F.aggregate(F.zip_with(t, F.col("_e"), lambda x, e: V.vscale(x, e / F.col("_z"))),
                      F.array_repeat(F.lit(0.0).cast("double"), dim), lambda a, v: V.vadd(a, v))
    return d.withColumn(out, F.when(F.col("_mx").isNotNull(), acc)).drop("_sc", "_mx", "_e", "_z")
