"""Strict lookup of token matrices (L x D for each sequence), wide and ragged, by late materialisation.

1. Which rows stay is decided on keys alone: the lookup table gives its key column, no matrix is read.
2. What stays asks for (row, chain, sequence); the matrices are fetched once for each of these by one join on the sequence.
   A table stored by ``store_tokens`` is bucketed and sorted by sequence, so only the narrow requests are
   shuffled for that join.
3. The matrices of a row come together by its id: the one exchange that carries matrices.

The sequences that are asked for most often, as many as have no more than ``HOT_BYTES`` of matrices together, are joined by
broadcast to the rows themselves: their requests stay spread over all tasks, and their matrices pass no exchange. Matrices are exchanged in
the type they are stored in and come back as doubles.

Policy as in ``lookup_strict``: heavy or antigen missing drops the row; an absent light chain (NULL or '') gives a matrix of
length 0 and status 'empty'; a light sequence without an embedding keeps the row with NULL and 'missing'.
Repeated rows, also with equal ids, each come back. A NULL row id keeps nothing together and is refused by an empty result for it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.config import state_path

CHAINS = ("heavy", "light", "antigen")
HOT_BYTES = 64 << 20


def store_tokens(emb: DataFrame, key: str = "seq", tokens: str = "tokens", buckets: int = 64, name: str | None = None) -> DataFrame:
    """Co-partitioned storage: one row per key, bucketed and sorted by it, as a table of the session's catalog whose files lie
    under the checkpoint folder (or under ``name``'s own path, once it exists)."""
    from pairlab.operators.joins import one_per_key

    spark = emb.sparkSession
    name = name or f"tokens_{uuid.uuid4().hex}"
    (one_per_key(emb, key, tokens).select(F.col(key).alias("seq"), F.col(tokens).alias("tokens")).where(F.col("seq").isNotNull())
     .write.bucketBy(buckets, "seq").sortBy("seq").option("path", state_path(spark, "token-store", name)).saveAsTable(name))
    return spark.table(name)


def _hot(spark: SparkSession, asked: DataFrame, stored: DataFrame) -> DataFrame | None:
    """(seq, tokens) of the sequences with the most requests, two at least, as many as fit HOT_BYTES, or None. Sequences that are asked for
    equally often are taken together or not at all."""
    width = 4 if stored.schema["tokens"].dataType.elementType.elementType.simpleString() == "float" else 8
    lengths = F.aggregate(F.col("tokens"), F.lit(0).cast("long"), lambda n, t: n + 24 + width * F.coalesce(F.size(t), F.lit(0)))
    root = state_path(spark, "token-hot", uuid.uuid4().hex)
    sizes = asked.groupBy("seq").agg(F.count("*").alias("n")).where("n > 1").join(stored, "seq")
    sizes.select("seq", "n", (F.coalesce(lengths, F.lit(0)) + F.octet_length("seq") + 64).alias("bytes")).write.parquet(f"{root}/sizes")
    sizes = spark.read.parquet(f"{root}/sizes")
    least, room = None, HOT_BYTES
    by_count = sizes.groupBy("n").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("n"))
    for r in by_count.toLocalIterator():  # a row for each number of requests, until they no longer fit
        room -= r["bytes"]
        if room < 0:
            break
        least = r["n"]
    if least is None:
        return None
    stored.join(sizes.where(F.col("n") >= least), "seq", "left_semi").select("seq", "tokens").write.parquet(f"{root}/hot")
    return spark.read.parquet(f"{root}/hot")


def lookup_tokens(pairs: DataFrame, stored: DataFrame, hot: bool = True) -> DataFrame:
    """``pairs`` with heavy_tokens, light_tokens, antigen_tokens and light_status. ``stored`` has one row per ``seq``.

    ``hot`` counts the requests first (a job on keys) and splits off the frequent sequences.
    """
    spark = pairs.sparkSession
    seqs = F.array(*[F.struct(F.lit(c).alias("chain"), F.col(f"{c}_seq").alias("seq")) for c in CHAINS])
    wanted = pairs.select("row_id", F.explode(seqs).alias("w")).select("row_id", "w.chain", "w.seq").where(F.coalesce("seq", F.lit("")) != "").distinct()
    known = stored.select("seq", F.lit(True).alias("known"))
    told = wanted.join(known, "seq", "left").groupBy("row_id").agg(
        *[F.coalesce(F.bool_or(F.when(F.col("chain") == c, F.col("known").isNotNull())), F.lit(False)).alias(c) for c in CHAINS])
    kept = told.where("heavy and antigen").select("row_id")
    asked = wanted.join(kept, "row_id", "left_semi")
    often = _hot(spark, asked, stored) if hot else None
    # the hot names alone as the broadcast side, so that the other requests are those without a match
    cold = asked if often is None else asked.join(F.broadcast(often.select("seq")), "seq", "left_anti")
    gathered = cold.join(stored, "seq").groupBy("row_id").agg(
        *[F.any_value(F.when(F.col("chain") == c, F.col("tokens")), True).alias(f"{c}_tokens") for c in CHAINS])
    if often is None:
        out = pairs.join(gathered, "row_id")
    else:
        out = pairs.join(kept, "row_id").join(gathered, "row_id", "left")
        for c in CHAINS:
            side = F.broadcast(often.select(F.col("seq").alias("_hot_seq"), F.col("tokens").alias("_hot_tokens")))
            out = out.join(side, F.col(f"{c}_seq") == F.col("_hot_seq"), "left").withColumn(
                f"{c}_tokens", F.coalesce("_hot_tokens", f"{c}_tokens")).drop("_hot_seq", "_hot_tokens")
    absent = F.coalesce("light_seq", F.lit("")) == ""
    none = F.array().cast(stored.schema["tokens"].dataType)
    light = F.when(absent, none).otherwise(F.col("light_tokens"))
    status = F.when(absent, "empty").when(F.col("light_tokens").isNull(), "missing").otherwise("hit")
    return out.select(*pairs.columns, *[(light if c == "light" else F.col(f"{c}_tokens")).cast("array<array<double>>").alias(f"{c}_tokens") for c in CHAINS],
                      status.alias("light_status"))
