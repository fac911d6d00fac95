"""Flagship: score the labelled pool with a fixed cosine scorer and pick the next batch.

pairs -(strict lookup)-> pooled H, L, Ag -> antibody vector -> cosine(ab, ag)
      -> p = (1 + cosine) / 2 -> binary entropy -> top-b by entropy (ties: row_id)

Physical shape: three key lookups (broadcast when the embedding side is small, checked by
count; otherwise shuffled with hot keys split off), one narrow projection stage with
JVM-side array lambdas, then TakeOrderedAndProject. No row-level data reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions import scores as S
from pairlab.functions import vectors as V
from pairlab.operators.acquire import top_by_score
from pairlab.operators.lookup import lookup_strict


def cosine_scores(pairs: DataFrame, emb: DataFrame) -> DataFrame:
    """(row_id, label, cosine, p, entropy) for every pair that passes the strict lookup."""
    looked = lookup_strict(pairs.select("row_id", "heavy_seq", "light_seq", "antigen_seq", "label"),
                           emb)
    ab = looked.select("row_id", "label", V.antibody("heavy_emb", "light_emb").alias("ab"), "antigen_emb")
    return (ab.select("row_id", "label", V.cosine("ab", "antigen_emb").alias("cosine"))
                  .withColumn("p", (F.lit(1.0) + F.col("cosine")) / F.lit(2.0))
                  .withColumn("entropy", S.binary_entropy("p")))


def flagship(pairs: DataFrame, emb: DataFrame, b: int = 96) -> DataFrame:
    return top_by_score(cosine_scores(pairs, emb), "entropy", b)
