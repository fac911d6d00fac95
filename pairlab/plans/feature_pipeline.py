"""From embedding files to cached pair features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.operators import features as FT
from pairlab.operators import lookup as LK
from pairlab.operators import tokens as TK
from pairlab.sources import readers as RD
from pairlab.sources import writers as WR


def feature_pipeline(spark: SparkSession, pairs: DataFrame, emb_path: str, cache_path: str, dim: int | None = None) -> DataFrame:
    """Embedding Parquet -> last one wins for a repeated sequence -> mean over tokens -> lenient lookup of the three
    chains -> [H | L | Ag] features cached by ``row_id`` -> joined back to the source rows of ``pairs``.

    ``dim`` is the width of a token. The flat layout needs it; the tensor layout tells it by its first row. An
    embedding table without rows gives an empty result of the same columns.
    """
    emb = RD.dedupe_last(RD.read_embeddings(spark, emb_path), "seq", ["_file", "_pos"])
    if dim is None:
        first = RD.read_embeddings(spark, emb_path).select(F.element_at("shape", 2)).first()
        if first is not None and first[0] is None:
            raise ValueError("flat embeddings do not tell their width: give dim")
        dim = 0 if first is None else int(first[0])
    pooled = TK.mean_pool(TK.decode_tokens(emb, dim)).select("seq", F.col("pooled").alias("embedding"))
    looked = LK.lookup_lenient(pairs.select("row_id", "heavy_seq", "light_seq", "antigen_seq", "label"), pooled, dim)
    WR.write_feature_cache(FT.concat_features(looked), cache_path)
    cache = spark.read.parquet(cache_path).select("row_id", "x")
    return pairs.join(cache, "row_id")
