"""The given parquet tables and the stand-in views built from them.

The reference reads a private triple table, an embedding table and per-experiment caches.
None of those ship, so every operator is exercised on views derived *by Spark* from the
given tables (schemas in FIXTURES.md). Each view is a plain projection/aggregation of a
whole table, so its size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _v(c: Column) -> Column:
    return F.concat(F.lit("v"), c.cast("string"))


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB: one pooled vector per sequence string (seq, embedding ARRAY<DOUBLE>, emb_label)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(_v(F.col("vec_id")).alias("seq"),
                    F.col("embedding").cast("array<double>").alias("embedding"),
                    F.col("label").alias("emb_label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of EMB in the type they are stored in, for lookups, which widen them behind their joins (seq, embedding)."""
    return table(spark, sf_dir, "embeddings").select(_v(F.col("vec_id")).alias("seq"), "embedding")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAIRS: labelled (heavy, light, antigen) triples keyed by ``row_id``.

    The key space is 1.2 x |embeddings|, so about one key in six has no embedding; light is
    NULL for one row in five and '' for one in seven of the rest (single-chain antibodies).
    """
    nk = table(spark, sf_dir, "embeddings").select(
        F.floor(F.count(F.lit(1)) * 12 / 10).cast("bigint")).scalar()
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("row_id"),
        _v((k * 7919) % nk).alias("heavy_seq"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .when(k % 7 == 0, F.lit(""))
         .otherwise(_v((k * 104729) % nk)).alias("light_seq"),
        _v(F.col("o_custkey") % nk).alias("antigen_seq"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Spike RBD"))
         .when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string"))
         .otherwise(F.lit("other")).alias("antigen_name"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCORES: (row_id, y, p) with p rounded to 2 digits so that ties occur."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0).alias("y"),
        F.round(F.col("value") / (F.col("value") + F.lit(50.0)), 2).alias("p"))


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PASSES: long table of stochastic forward passes (row_id = candidate, pass, p)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("row_id"), F.col("event_id").alias("pass"),
                     (F.col("value") / (F.col("value") + F.lit(50.0))).alias("p"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RESULTS: one metric row per (model, strategy, seed, round)."""
    li = table(spark, sf_dir, "lineitem")
    model = F.when(F.col("l_linestatus") == "O", "rf").otherwise("mlp_mcdropout").alias("model")
    strategy = (F.when(F.col("l_returnflag") == "A", "random")
                .when(F.col("l_returnflag") == "R", "uncertainty")
                .otherwise("hybrid").alias("strategy"))
    return (li.groupBy(model, strategy,
                       (F.col("l_suppkey") % 5).alias("seed"),
                       (F.col("l_linenumber") - 1).alias("round"),
                       (F.lit(100) + F.lit(96) * (F.col("l_linenumber") - 1)).alias("n_labeled"))
            .agg(F.avg(1 - F.col("l_discount")).alias("accuracy"),
                 F.avg(1 - F.col("l_tax")).alias("f1"),
                 F.avg(F.col("l_quantity") / 50.0).alias("auprc")))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EPOCHS: per (epoch, worker) partial sums, as each worker reports them."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_linenumber").alias("epoch"), (F.col("l_suppkey") % 4).alias("worker"))
            .agg(F.sum("l_extendedprice").alias("loss_sum"),
                 F.sum(F.floor(F.col("l_quantity") * F.col("l_discount") * 10)).cast("bigint").alias("correct"),
                 F.sum("l_quantity").cast("bigint").alias("n")))


def leaves(spark: SparkSession, sf_dir: str, trees: int = 5, n_leaves: int = 16) -> DataFrame:
    """LEAVES: long (row_id, tree, leaf) table of a 5-tree forest over every order."""
    o = table(spark, sf_dir, "orders")
    return (o.select(F.col("o_orderkey").alias("row_id"), "o_custkey",
                     F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"))
            .select("row_id", "tree",
                    ((F.col("row_id") * 7919 + F.col("tree") * F.col("o_custkey")) % n_leaves).alias("leaf")))


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQS: sequences to encode (row_id, seq)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.col("text").alias("seq"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOKENS: per-residue embedding table in the struct layout ``embedding{data, shape}``.

    A "sequence" is the set of vectors sharing (vec_id div 40, label), ordered by vec_id,
    so every sequence has between 1 and 40 tokens (bounded group, variable length).
    """
    e = table(spark, sf_dir, "embeddings")
    dim = F.size("embedding")
    grouped = (e.groupBy(F.concat(F.lit("t"), F.floor(F.col("vec_id") / 40).cast("string"),
                                  F.lit("_"), F.col("label").cast("string")).alias("text"))
               .agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("toks"),
                    F.max(dim).alias("d")))
    return grouped.select(
        "text",
        F.struct(F.flatten(F.transform("toks", lambda t: t["embedding"])).alias("data"),
                 F.array(F.size("toks").cast("bigint"), F.col("d").cast("bigint")).alias("shape"))
        .alias("embedding"))


def token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOKEN_PAIRS: labelled triples of keys of TOKENS; some keys have no matrix, the light chain is absent as in PAIRS."""
    groups = table(spark, sf_dir, "embeddings").select((F.floor(F.max("vec_id") / 40) + 2).cast("bigint")).scalar()
    k = F.col("o_orderkey")

    def name(group: Column, label: Column) -> Column:
        return F.concat(F.lit("t"), (group % groups).cast("string"), F.lit("_"), (label % 11).cast("string"))

    return table(spark, sf_dir, "orders").select(
        k.alias("row_id"), name(k * 7919, k).alias("heavy_seq"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 7 == 0, F.lit("")).otherwise(name(k * 31, k * 3)).alias("light_seq"),
        name(F.col("o_custkey"), F.col("o_custkey") * 7).alias("antigen_seq"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))
