"""Neighbourhood structure without pair enumeration.

Forest proximity between two rows is the share of trees routing them to the same leaf.
Everything reported here is a per-row or per-group aggregate of that relation, computed
from leaf occupancy counts: a leaf holding n rows contributes n-1 neighbours to each of its
rows, so no (row, row) pair is ever materialised -- a leaf holding a third of all rows
costs one count, not n^2 pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions import vectors as V


def leaf_occupancy(leaves: DataFrame) -> DataFrame:
    """(tree, leaf, n): rows per leaf."""
    return leaves.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"))


def leaf_proximity(leaves: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Per row: co-leaf neighbours summed over trees, and mean proximity to all other rows.

    mean_proximity = sum_t (n_t(leaf) - 1) / (T * (N - 1)), i.e. the row sum of the
    proximity matrix divided by N-1.
    """
    occ = leaf_occupancy(leaves)
    n_rows = leaves.select(F.countDistinct(id_col)).scalar()
    n_trees = leaves.select(F.countDistinct("tree")).scalar()
    j = leaves.join(occ, ["tree", "leaf"])
    g = j.groupBy(id_col).agg(F.sum(F.col("n") - 1).alias("shared_leaves"))
    return g.select(id_col, "shared_leaves",
                    F.try_divide(F.col("shared_leaves"), (n_trees * (n_rows - 1)).cast("double")).alias("mean_proximity"))


def proximity_totals(leaves: DataFrame) -> DataFrame:
    """Whole-forest totals: sum over trees and leaves of n(n-1)/2 co-leaf pairs."""
    occ = leaf_occupancy(leaves)
    return occ.groupBy("tree").agg((F.sum(F.col("n") * (F.col("n") - 1)) / 2).cast("bigint").alias("pairs_sharing"),
                                   F.count(F.lit(1)).alias("leaves_used"), F.max("n").alias("largest_leaf"))


def neighbour_label_agreement(leaves: DataFrame, labels: DataFrame, id_col: str = "row_id",
                              label: str = "label") -> DataFrame:
    """Per row: proximity-weighted share of its co-leaf neighbours that carry its label."""
    lv = leaves.join(labels.select(id_col, label), id_col)
    occ = lv.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
    occ_l = lv.groupBy("tree", "leaf", label).agg(F.count(F.lit(1)).alias("n_same"))
    j = lv.join(occ, ["tree", "leaf"]).join(occ_l, ["tree", "leaf", label])
    g = j.groupBy(id_col, label).agg(F.sum(F.col("n") - 1).alias("neighbours"),
                                     F.sum(F.col("n_same") - 1).alias("same_label"))
    return g.withColumn("agreement", F.try_divide(F.col("same_label").cast("double"), F.col("neighbours")))


def class_centroids(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Mean vector per cluster with ``Summarizer`` (map-side partial sums, no explode)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    g = df.groupBy(cluster).agg(Summarizer.mean(array_to_vector(vec)).alias("_m"))
    return g.select(cluster, vector_to_array("_m").alias("center"))


def centroid_distance(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Per row: distance to its own cluster centroid (between/within-class geometry)."""
    c = class_centroids(df, vec, cluster)
    return df.join(c, cluster).withColumn("dist", V.euclidean(vec, "center"))


#: Widest vectors whose covariance (8 bytes for each pair of dimensions) the driver takes.
PCA_WIDTH = 8192


def project_2d(df: DataFrame, vec: str, k: int = 2, out: str = "xy") -> DataFrame:
    """Linear 2-D projection (PCA) of standardised vectors for plotting.

    The covariance is decomposed on the driver, so widths over PCA_WIDTH are refused.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    first = df.select(F.size(vec)).first()
    if first is not None and first[0] > PCA_WIDTH:
        raise ValueError(f"vectors of {first[0]} dimensions: project_2d takes at most {PCA_WIDTH}")
    d = df.withColumn("_v", array_to_vector(vec))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(d)
    return model.transform(d).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def _product(df: DataFrame, vec: str, mean, q, outer: bool):
    """Sums over the rows x (less the mean): with ``outer`` the d x l matrix of x (x q), else the l x l matrix of (x q)(x q).

    One job; every task adds up its rows, the columns are summed by a grouped aggregate, and l columns reach the driver.
    """
    import numpy as np
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    shared = df.sparkSession.sparkContext.broadcast((mean, q))

    def run(batches):
        import pandas as pd
        mu, basis = shared.value
        total = np.zeros((len(mu) if outer else basis.shape[1], basis.shape[1]))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy()).astype(np.float64) - mu
                y = x @ basis
                total += (x if outer else y).T @ y
        yield pd.DataFrame({"column": range(total.shape[1]), "sums": list(total.T)})

    parts = df.select(vec).mapInPandas(run, "column int, sums array<double>")
    rows = parts.groupBy("column").agg(Summarizer.sum(array_to_vector("sums")).alias("s")).select("column", vector_to_array("s").alias("s")).collect()
    shared.unpersist()
    return np.stack([np.asarray(r["s"]) for r in sorted(rows, key=lambda r: r["column"])], axis=1)


def project_sketch(df: DataFrame, vec: str, k: int = 2, out: str = "xy", extra: int = 8, passes: int = 4, seed: int = 7) -> DataFrame:
    """The PCA plane of vectors of any width: a randomised range finder, ``passes`` power steps and a small eigenproblem.

    Only d x (k + extra) matrices reach the driver, never the d x d covariance. ``df`` should be a written table: it
    is read passes + 2 times. The axes are ordered by variance, uncorrelated, centred, and turned so that the largest
    loading of each is positive. An empty table gives no rows.
    """
    import numpy as np
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    mean = df.select(vector_to_array(Summarizer.mean(array_to_vector(vec))).alias("m")).first()["m"] if not df.isEmpty() else []
    schema_out = df.withColumn(out, F.array().cast("array<double>"))
    if not mean:
        return schema_out.limit(0)
    mean = np.asarray(mean)
    q = np.random.default_rng(seed).normal(size=(len(mean), min(k + extra, len(mean))))
    for _ in range(passes):
        q, _ = np.linalg.qr(_product(df, vec, mean, q, True))
    values, turn = np.linalg.eigh(_product(df, vec, mean, q, False))
    axes = q @ turn[:, np.argsort(values)[::-1][:k]]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    shared = df.sparkSession.sparkContext.broadcast((mean, axes))

    def place(batches):
        mu, a = shared.value
        for pdf in batches:
            if len(pdf):
                pdf[out] = list((np.stack(pdf[vec].to_numpy()).astype(np.float64) - mu) @ a)
                yield pdf

    return df.mapInPandas(place, schema_out.schema)


def separability(df: DataFrame, vec: str, label: str = "label") -> DataFrame:
    """One row: n, within and between scatter (traces), their ratio, and the mean centroid silhouette.

    Scatter comes from sums of each class; the silhouette of a row is (b - a) / max(a, b) with a its distance to the centroid of
    its class and b to the nearest other one. NULL where there is one class only, or no scatter. Centroids are one row a class.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = df.where(F.col(label).isNotNull() & F.col(vec).isNotNull())
    square = V.dot(vec, F.col(vec))
    of = (rows.groupBy(F.col(label).alias("_c")).agg(F.count("*").alias("n"), vector_to_array(Summarizer.mean(array_to_vector(vec))).alias("center"),
                                                    F.sum(square).alias("squares")))
    mass = F.col("squares") - F.col("n") * V.dot("center", F.col("center"))
    # the grand mean from the class means: as many rows as classes
    scaled = F.transform("center", lambda v: v * F.col("n"))
    total = of.select(F.sum("n").alias("total"), F.sum("squares").alias("all_squares"), F.sum(mass).alias("within"),
                      vector_to_array(Summarizer.sum(array_to_vector(scaled))).alias("sums"))
    between = (F.col("all_squares") - F.col("within")) - V.dot("sums", F.col("sums")) / F.col("total")
    centres = of.agg(F.collect_list(F.struct("_c", "center")).alias("centres"))
    far = F.transform("centres", lambda c: F.struct((c["_c"] == F.col(label)).alias("own"), V.euclidean(F.col(vec), c["center"]).alias("d")))
    near = rows.withColumn("centres", centres.scalar()).select(far.alias("far"))
    a = F.array_min(F.transform(F.filter("far", lambda x: x["own"]), lambda x: x["d"]))
    b = F.array_min(F.transform(F.filter("far", lambda x: ~x["own"]), lambda x: x["d"]))
    sil = near.select(F.try_divide(b - a, F.greatest(a, b)).alias("s")).agg(F.avg("s").alias("silhouette"))
    return (total.select(F.col("total").alias("n"), "within", between.alias("between")).withColumn("ratio", F.try_divide("between", "within"))
            .withColumn("silhouette", sil.scalar()))
