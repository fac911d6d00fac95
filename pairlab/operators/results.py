"""Experiment-result tables: learning curves over seeds, bands, final rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("accuracy", "f1", "auprc", "auroc")


def learning_curve(results: DataFrame, metrics=("accuracy", "f1", "auprc"),
                   by=("model", "strategy", "n_labeled")) -> DataFrame:
    """Mean and sample std of every metric over seeds, one pass; a single seed gives NULL std."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n_seeds"), *aggs)


def learning_curve_band(results: DataFrame, metric: str = "accuracy",
                        by=("model", "strategy", "n_labeled")) -> DataFrame:
    """mean +- 1 sample std of one metric."""
    g = results.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
    return g.select(*by, "mean", "std", (F.col("mean") - F.col("std")).alias("lower"),
                    (F.col("mean") + F.col("std")).alias("upper"))


def final_round(results: DataFrame, metrics=("accuracy", "f1", "auprc"),
                by=("model", "strategy", "seed"), round_col: str = "round") -> DataFrame:
    """The metrics of the last round of each run (max_by on the round number)."""
    return results.groupBy(*by).agg(F.max(round_col).alias("last_round"),
                                    *[F.max_by(m, round_col).alias(f"final_{m}") for m in metrics])


def filter_results(results: DataFrame, **equals) -> DataFrame:
    """Result-table filter on model / strategy / batch_size etc."""
    cond = F.lit(True)
    for k, v in equals.items():
        cond = cond & (F.col(k) == F.lit(v))
    return results.where(cond)
