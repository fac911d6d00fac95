"""Gradient-boosted trees on labelled rows, fitted by Spark and applied as a DataFrame."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL = "label"


def bounded(rows: DataFrame, limit: int, *key: str) -> DataFrame:
    """At most about ``limit`` rows, chosen by a hash of ``key``: the same rows however they are partitioned."""
    n = rows.count()
    if n <= limit:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(1_000_000)) < int(limit / n * 1_000_000))


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features").transform(rows)


def fit(sample: DataFrame, features: list[str], rounds: int = 20, depth: int = 4, times: str | None = None) -> GBTClassificationModel | None:
    """A model, or None where the sample has fewer than 20 rows of either label. ``times`` says how often each row stands."""
    n = {r[LABEL]: r["n"] for r in sample.groupBy(LABEL).agg((F.sum(times) if times else F.count("*")).alias("n")).collect()}
    if min(n.get(0, 0), n.get(1, 0)) < 20:
        return None
    gbt = GBTClassifier(featuresCol="_features", labelCol=LABEL, maxIter=rounds, maxDepth=depth, maxBins=32,
                        stepSize=0.2, seed=7, checkpointInterval=-1, cacheNodeIds=False)
    if times:   # weightCol=None would set the column to null
        gbt.setWeightCol(times)
    return gbt.fit(assembled(sample.withColumn(LABEL, F.col(LABEL).cast("double")), features))


def score(model: GBTClassificationModel, rows: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    """``rows`` with the model's probability of label 1."""
    out = model.transform(assembled(rows, features))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")
