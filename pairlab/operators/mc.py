"""Summaries of stochastic forward passes (MC dropout) and of model ensembles.

Input is the long table (row_id, pass, p). The summary is a grouped aggregate, so a row with
many passes is combined map-side and never gathered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions.scores import binary_entropy


def mc_summary(passes: DataFrame, id_col: str = "row_id", p: str = "p") -> DataFrame:
    """mean_p, population variance and std, binary entropy of the mean, number of passes."""
    g = passes.groupBy(id_col).agg(F.avg(p).alias("mean_p"), F.var_pop(p).alias("var_p"),
                                   F.stddev_pop(p).alias("std_p"), F.count(F.lit(1)).alias("n_passes"))
    return g.withColumn("entropy", binary_entropy("mean_p"))


def ensemble_variance(passes: DataFrame, model_col: str = "model", id_col: str = "row_id",
                      p: str = "p") -> DataFrame:
    """Ensemble disagreement: each model's mean p per row, then population variance across models."""
    per_model = passes.groupBy(id_col, model_col).agg(F.avg(p).alias("model_p"))
    return per_model.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_models"),
                                         F.avg("model_p").alias("mean_p"),
                                         F.var_pop("model_p").alias("var_p"))
