"""Class weights and column standardisation fitted on the pool only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n = counts.select(F.sum("n_c")).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    return counts.select(label, "n_c", (n / (k * F.col("n_c"))).alias("weight"))


def pos_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """BCE positive-class weight n_neg / max(n_pos, 1)."""
    g = df.agg(F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos"))
    return g.select("n_neg", "n_pos", (F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))).alias("pos_weight"))


def standard_scale_fit(df: DataFrame, x: str = "x") -> DataFrame:
    """Per-dimension mean and population std of a vector column: one row (mean, std, n).

    ``Summarizer`` is one aggregate with map-side partial buffers of dim-wide vectors (no
    explode of rows x dims). It reports the sample variance, rescaled here by (n-1)/n.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    s = df.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(x)).alias("s"))
    n = F.col("s.count")
    var_pop = F.transform(vector_to_array("s.variance"),
                          lambda v: F.when(n > 1, v * (n - 1) / n).otherwise(F.lit(0.0)))
    return s.select(vector_to_array("s.mean").alias("mean"), F.transform(var_pop, F.sqrt).alias("std"),
                    n.alias("n"))


def scaler_long(stats: DataFrame) -> DataFrame:
    """(i, mean, std) rows of a fitted scaler, 0-based dimension index."""
    return stats.select(F.posexplode(F.arrays_zip("mean", "std")).alias("i", "ms")).select(
        "i", F.col("ms.mean").alias("mean"), F.col("ms.std").alias("std"))


def standard_scale_apply(df: DataFrame, stats: DataFrame, x: str = "x", out: str = "x_scaled") -> DataFrame:
    """(x - mean) / std per dimension, std 0 -> 1; the fitted arrays are scalar subqueries."""
    std = F.transform("std", lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s))
    d = df.withColumn("_fit", stats.select(F.struct("mean", std.alias("std"))).scalar())  # one subquery: the fit runs once
    return d.withColumn(out, F.zip_with(F.zip_with(F.col(x), F.col("_fit.mean"), lambda v, m: v - m), F.col("_fit.std"),
                                        lambda c, s: c / s)).drop("_fit")
