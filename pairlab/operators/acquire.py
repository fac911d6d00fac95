"""Acquisition: choose the next batch to label from the unlabelled pool.

Every rule ends in a distributed top-k (``orderBy(...).limit(b)``, planned as
TakeOrderedAndProject: each task keeps its own b best rows, the driver merges
``tasks x b`` rows). Nothing row-level is collected. Ties break on ``row_id``; scores
are rounded to 12 digits first so float noise cannot reorder equal scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions import scores as S
from pairlab.functions import vectors as V


def top_by_score(df: DataFrame, score: str, b: int, id_col: str = "row_id") -> DataFrame:
    """The b rows with the highest score (b = min(batch, pool) automatically)."""
    return df.orderBy(S.tie_key(score).desc(), F.col(id_col).asc()).limit(int(b))


def acquire_random(pool: DataFrame, b: int, seed: int, round_: int = 0, id_col: str = "row_id") -> DataFrame:
    """Passive acquisition: b rows in md5(seed:round:row_id) order, without replacement."""
    return (pool.withColumn("draw", S.draw_key(id_col, seed, round_))
                .orderBy("draw", id_col).limit(int(b)).drop("draw"))


def acquire_entropy(scored: DataFrame, b: int, p: str = "p", id_col: str = "row_id") -> DataFrame:
    """Uncertainty acquisition: highest binary entropy of the (mean) probability."""
    return top_by_score(scored.withColumn("entropy", S.binary_entropy(p)), "entropy", b, id_col)


def salience_zscore(cands: DataFrame, mag: str = "salience", out: str = "z") -> DataFrame:
    """z-score of the salience within this candidate set: (m - mean) / (pop_std + 1e-8).

    Mean and population std are scalar subqueries (one aggregate job, one value each),
    not a global window, so no single task ever holds the candidate set.
    """
    st = cands.select(F.struct(F.avg(mag).alias("mu"), F.stddev_pop(mag).alias("sd"))).scalar()
    return cands.withColumn(out, (F.col(mag) - st["mu"]) / (st["sd"] + F.lit(1e-8)))


def acquire_weighted(cands: DataFrame, b: int, ent: str = "entropy", mag: str = "salience",
                     w: float = 0.12, id_col: str = "row_id") -> DataFrame:
    """Salience-weighted uncertainty: ent * (1 + w*tanh(z(mag))) over the candidate set."""
    z = salience_zscore(cands, mag, "z")
    return top_by_score(z.withColumn("wscore", S.weighted_score(ent, "z", w)), "wscore", b, id_col)


def acquire_hybrid(cands: DataFrame, b: int, seed: int, round_: int = 0, ent: str = "entropy",
                   mag: str = "salience", w: float = 0.12, id_col: str = "row_id") -> DataFrame:
    """b//2 random picks, then the weighted rule on the remainder (z recomputed on it).

    If the remainder has no more rows than are still needed, all of it is taken.
    Output: (row_id, part) with part in {'random', 'weighted'}.
    """
    n_rand = int(b) // 2
    n_w = int(b) - n_rand
    rand = acquire_random(cands.select(id_col), n_rand, seed, round_, id_col)
    rest = cands.join(rand, id_col, "left_anti")
    if n_w <= 0:
        weighted = rest.limit(0)
    else:
        weighted = acquire_weighted(rest, n_w, ent, mag, w, id_col)
    return (rand.select(id_col, F.lit("random").alias("part"))
            .unionByName(weighted.select(id_col, F.lit("weighted").alias("part"))))


def nearest_to_center(df: DataFrame, centers: DataFrame, vec: str, cluster: str,
                      center_vec: str = "center", id_col: str = "row_id") -> DataFrame:
    """Per cluster, the member closest to its centre (first row_id on ties).

    ``centers`` has one row per cluster; Spark broadcasts it where its size allows.
    The argmin is a grouped ``min(struct(dist, row_id))``: partial aggregation on the map
    side, so even a cluster holding a third of the rows never lands whole in one task.
    """
    d = (df.join(centers.select(cluster, center_vec), cluster)
           .withColumn("dist", V.euclidean(vec, center_vec)))
    best = d.groupBy(cluster).agg(F.min(F.struct("dist", id_col)).alias("m"))
    return best.select(cluster, F.col(f"m.{id_col}").alias(id_col), F.col("m.dist").alias("dist"))
