"""Pair -> embedding lookups (strict and lenient policies), set operators on the pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.functions.vectors import zeros
from pairlab.operators.joins import lookup_join, one_per_key, spread

CHAINS = ("heavy", "light", "antigen")


def _no_chain(c: str):
    """NULL or '' means the chain is absent (single-chain antibody for light)."""
    return F.coalesce(F.col(c), F.lit("")) == ""


def _side(emb: DataFrame, chain: str, key: str, vec: str) -> DataFrame:
    return emb.select(F.col(key).alias(f"_{chain}_k"), F.col(vec).alias(f"{chain}_emb"))


def _wide(vec: str):
    """The vector as doubles: cast behind the joins, so that vectors stored as floats are shuffled as floats."""
    return F.col(vec).cast("array<double>")


def lookup_strict(pairs: DataFrame, emb: DataFrame, key: str = "seq", vec: str = "embedding") -> DataFrame:
    """Strict policy: drop a row whose heavy or antigen sequence has no embedding.

    Light chain: absent ('' or NULL) gives ``light_status='empty'`` and a NULL vector
    (the zero-length token matrix); a hit gives the vector; a non-empty miss keeps the
    row with a NULL vector and ``light_status='missing'``.
    """
    emb = one_per_key(emb, key, vec)
    # the light chain first: a row without one carries nothing into the next two shuffles
    out = spread(pairs).withColumn("_light_probe", F.when(_no_chain("light_seq"), F.lit(None)).otherwise(F.col("light_seq")))
    out = lookup_join(out, _side(emb, "light", key, vec), "_light_probe", "_light_k", "left").drop("_light_probe")
    for chain in ("heavy", "antigen"):
        out = lookup_join(out, _side(emb, chain, key, vec), f"{chain}_seq", f"_{chain}_k", "inner")
    status = (F.when(_no_chain("light_seq"), "empty")
              .when(F.col("light_emb").isNull(), "missing").otherwise("hit"))
    return out.select(*pairs.columns, *[_wide(f"{c}_emb").alias(f"{c}_emb") for c in ("heavy", "antigen", "light")], status.alias("light_status"))


def lookup_lenient(pairs: DataFrame, emb: DataFrame, dim: int, key: str = "seq",
                   vec: str = "embedding", keep_any: bool = True) -> DataFrame:
    """Lenient policy: left-join every chain, zero-fill misses, keep a row if any chain hit.

    Adds ``heavy_hit``, ``light_hit``, ``antigen_hit`` flags and zero-filled
    ``h``, ``l``, ``ag`` vectors. ``keep_any=False`` returns every row (for coverage).
    """
    emb = one_per_key(emb, key, vec)
    out = spread(pairs)
    for chain in ("light", "heavy", "antigen"):  # the chain that most rows lack is the one that is shuffled most often
        out = out.withColumn(f"_{chain}_probe",
                             F.when(_no_chain(f"{chain}_seq"), F.lit(None)).otherwise(F.col(f"{chain}_seq")))
        out = lookup_join(out, _side(emb, chain, key, vec), f"_{chain}_probe", f"_{chain}_k", "left")
        out = out.withColumn(f"{chain}_hit", F.col(f"{chain}_emb").isNotNull()).drop(f"_{chain}_probe")
    z = zeros(dim)
    out = out.select(*pairs.columns, *[f"{c}_hit" for c in CHAINS], F.coalesce(_wide("heavy_emb"), z).alias("h"),
                     F.coalesce(_wide("light_emb"), z).alias("l"), F.coalesce(_wide("antigen_emb"), z).alias("ag"))
    if keep_any:
        out = out.where(F.col("heavy_hit") | F.col("light_hit") | F.col("antigen_hit"))
    return out


def lookup_coverage(pairs: DataFrame, emb: DataFrame, key: str = "seq") -> DataFrame:
    """Counters of the lenient lookup in one aggregate row: kept, skipped and hits per chain.

    Joins the keys alone; no vector is read.
    """
    out = spread(pairs.select("heavy_seq", "light_seq", "antigen_seq"))
    known = emb.select(key).distinct()
    for chain in CHAINS:
        side = known.select(F.col(key).alias("_k"), F.lit(True).alias(f"{chain}_hit"))
        probe = F.when(_no_chain(f"{chain}_seq"), F.lit(None)).otherwise(F.col(f"{chain}_seq"))
        out = lookup_join(out.withColumn("_probe", probe), side, "_probe", "_k", "left")
        out = out.withColumn(f"{chain}_hit", F.coalesce(f"{chain}_hit", F.lit(False))).drop("_probe")
    any_hit = F.col("heavy_hit") | F.col("light_hit") | F.col("antigen_hit")
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(any_hit).alias("kept"),
        F.count_if(~any_hit).alias("skipped"),
        F.count_if("heavy_hit").alias("heavy_hits"),
        F.count_if("light_hit").alias("light_hits"),
        F.count_if("antigen_hit").alias("antigen_hits"),
        F.count_if(F.col("heavy_hit") & F.col("antigen_hit")).alias("strict_kept"),
    )


def write_lookup(pairs: DataFrame, emb: DataFrame, dim: int, path: str, key: str = "seq", vec: str = "embedding") -> DataFrame:
    """Write the lenient lookup and return its coverage counters, observed on the rows as they were written: the pairs are
    scanned and joined once. The counters are those of ``lookup_coverage``."""
    from pyspark.sql import Observation

    seen = Observation()
    hit = {c: F.col(f"{c}_hit") for c in CHAINS}
    any_hit = hit["heavy"] | hit["light"] | hit["antigen"]
    every = lookup_lenient(pairs, emb, dim, key, vec, keep_any=False).observe(
        seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(any_hit).alias("kept"), F.count_if(~any_hit).alias("skipped"),
        *[F.count_if(hit[c]).alias(f"{c}_hits") for c in CHAINS], F.count_if(hit["heavy"] & hit["antigen"]).alias("strict_kept"))
    every.where(any_hit).write.parquet(path)
    got = seen.get
    return pairs.sparkSession.createDataFrame([tuple(got.values())], ", ".join(f"{k} long" for k in got))


def composite_key(df: DataFrame) -> DataFrame:
    """The reference's concatenated string key heavy+light+antigen (NULL light as '')."""
    return df.withColumn("pair_key", F.concat(F.coalesce("heavy_seq", F.lit("")),
                                              F.coalesce("light_seq", F.lit("")),
                                              F.coalesce("antigen_seq", F.lit(""))))


KEY3 = ["heavy_seq", "light_key", "antigen_seq"]


def _key3(df: DataFrame) -> DataFrame:
    return df.withColumn("light_key", F.coalesce("light_seq", F.lit("")))


def pool_minus_selected(pool: DataFrame, selected: DataFrame) -> DataFrame:
    """Every pool row whose (heavy, light, antigen) triple was selected leaves the pool.

    Joins on the three columns (NULL light treated as ''), not on a concatenated string,
    so 'AB'+'C' and 'A'+'BC' stay distinct keys.
    """
    sel = _key3(selected).select(*KEY3).distinct()
    return _key3(pool).join(sel, KEY3, "left_anti").drop("light_key")


def gather_selected(pool: DataFrame, picked_ids: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Full records of the picked ids (a semi join, so duplicates in the picks are harmless)."""
    return pool.join(picked_ids.select(id_col), id_col, "left_semi")


def distinct_keys(*dfs: DataFrame) -> DataFrame:
    """Set union of (heavy, light, antigen) triples."""
    out = None
    for d in dfs:
        k = _key3(d).select(*KEY3)
        out = k if out is None else out.unionByName(k)
    return out.distinct()
