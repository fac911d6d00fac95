"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the given tables through the stand-in views of ``pairlab.sources.tables``
and runs one operator (or a short composition) over the whole of them. Double columns are
rounded to 6 digits at the very end so results compare across engines; ranking and
filtering always use the unrounded values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from pairlab.functions import scores as S
from pairlab.functions import vectors as V
from pairlab.operators import acquire as A
from pairlab.operators import features as FT
from pairlab.operators import lookup as LK
from pairlab.plans import feature_pipeline as FP
from pairlab.plans.flagship import cosine_scores, flagship
from pairlab.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (compare-friendly); +0.0 folds -0.0 into 0.0."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append((F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def finish_exact(df: DataFrame, digits: int = 6) -> DataFrame:
    """``finish`` by way of decimals of 12 digits: a mean that lies on half of the last digit rounds alike everywhere."""
    return finish(df.select(*[F.round(F.col(f.name).cast("decimal(38,12)"), digits).cast("double").alias(f.name)
                              if isinstance(f.dataType, DoubleType) else f.name for f in df.schema.fields]), digits)


def vec_stats(c, prefix: str) -> list:
    """Size, element sum and L2 norm of a vector column (compact, comparable summary)."""
    c = V.col_of(c)
    return [F.size(c).alias(f"{prefix}_n"), V.vsum(c).alias(f"{prefix}_sum"), V.l2norm(c).alias(f"{prefix}_norm")]


def dim_of(spark: SparkSession, sf_dir: str):
    """Embedding width as a scalar subquery (64 in the test tables, 1536 in production)."""
    return T.table(spark, sf_dir, "embeddings").select(F.max(F.size("embedding"))).scalar()


def _dim_int(spark, sf_dir) -> int:
    # the width of one row; the lenient lookup builds its zero vector from it
    return int(T.table(spark, sf_dir, "embeddings").select(F.size("embedding")).first()[0])


def lenient(spark, sf_dir) -> DataFrame:
    return LK.lookup_lenient(T.pairs(spark, sf_dir), T.vectors(spark, sf_dir), _dim_int(spark, sf_dir))


def strict(spark, sf_dir) -> DataFrame:
    return LK.lookup_strict(T.pairs(spark, sf_dir), T.vectors(spark, sf_dir))


# ---------------------------------------------------------------- flagship / lookups
@register("flagship")
def q_flagship(spark, sf_dir):
    return finish(flagship(T.pairs(spark, sf_dir), T.vectors(spark, sf_dir), 96)
                  .select("row_id", "cosine", "p", "entropy"))


@register("lookup_strict")
def q_lookup_strict(spark, sf_dir):
    s = strict(spark, sf_dir)
    return finish(s.select("row_id", "label", "light_status",
                           V.vsum("heavy_emb").alias("heavy_sum"),
                           V.vsum("light_emb").alias("light_sum"),
                           V.vsum("antigen_emb").alias("antigen_sum")))


@register("lookup_lenient")
def q_lookup_lenient(spark, sf_dir):
    s = lenient(spark, sf_dir)
    return finish(s.select("row_id", "label", "heavy_hit", "light_hit", "antigen_hit",
                           V.vsum("h").alias("h_sum"), V.vsum("l").alias("l_sum"), V.vsum("ag").alias("ag_sum")))


@register("lookup_coverage")
def q_lookup_coverage(spark, sf_dir):
    return LK.lookup_coverage(T.pairs(spark, sf_dir), T.emb(spark, sf_dir))


@register("lookup_coverage_observed")
def q_lookup_coverage_observed(spark, sf_dir):
    """Coverage counters observed while the lenient lookup is written."""
    return LK.write_lookup(T.pairs(spark, sf_dir), T.vectors(spark, sf_dir), _dim_int(spark, sf_dir), scratch(spark, "lookup"))


@register("broadcast_lookup")
def q_broadcast_lookup(spark, sf_dir):
    """Antigen-only lookup (the replicated-dimension side): hits per antigen name."""
    p = T.pairs(spark, sf_dir)
    side = T.emb(spark, sf_dir).select(F.col("seq").alias("_k"), F.col("embedding").alias("antigen_emb"))
    from pairlab.operators.joins import lookup_join
    j = lookup_join(p, side, "antigen_seq", "_k", "inner")
    return finish(j.groupBy("antigen_name").agg(F.count(F.lit(1)).alias("n"),
                                                 F.sum(V.vsum("antigen_emb")).alias("emb_sum")))


# ---------------------------------------------------------------- feature vectors
@register("concat_features")
def q_concat_features(spark, sf_dir):
    x = FT.concat_features(lenient(spark, sf_dir))
    return finish(x.select("row_id", *vec_stats("x", "x")))


@register("component_views")
def q_component_views(spark, sf_dir):
    d = _dim_int(spark, sf_dir)
    x = FT.component_views(FT.concat_features(lenient(spark, sf_dir)), d)
    return finish(x.select("row_id", *vec_stats("x_antigen", "antigen"), *vec_stats("x_antibody", "antibody")))


@register("antibody_vector")
def q_antibody_vector(spark, sf_dir):
    x = FT.antibody_vector(lenient(spark, sf_dir))
    return finish(x.select("row_id", "has_light", *vec_stats("ab", "ab")))


@register("hadamard")
def q_hadamard(spark, sf_dir):
    x = FT.interaction_features(lenient(spark, sf_dir))
    return finish(x.select("row_id", *vec_stats("hadamard", "had")))


@register("abs_diff")
def q_abs_diff(spark, sf_dir):
    x = FT.interaction_features(lenient(spark, sf_dir))
    return finish(x.select("row_id", *vec_stats("abs_diff", "ad")))


@register("cosine_pair")
def q_cosine_pair(spark, sf_dir):
    x = FT.interaction_features(lenient(spark, sf_dir))
    return finish(x.select("row_id", "cosine"))


@register("interaction_features")
def q_interaction_features(spark, sf_dir):
    x = FT.interaction_features(lenient(spark, sf_dir), packed=True)
    return finish(x.select("row_id", "label", *vec_stats("x_int", "xi")))


@register("feature_block")
def q_feature_block(spark, sf_dir):
    x = FT.feature_block(FT.interaction_features(FT.concat_features(lenient(spark, sf_dir)), packed=True))
    return finish(x.select("row_id", *vec_stats("x_all", "xa")))


@register("salience_norm")
def q_salience_norm(spark, sf_dir):
    x = FT.salience(FT.interaction_features(lenient(spark, sf_dir)))
    return finish(x.select("row_id", "salience"))


@register("composite_key")
def q_composite_key(spark, sf_dir):
    return LK.composite_key(T.pairs(spark, sf_dir)).select("row_id", "pair_key")


# ---------------------------------------------------------------- scalar scores on the fixed scorer
@register("sigmoid_score")
def q_sigmoid_score(spark, sf_dir):
    """Logit of the fixed scorer = 4*cosine; probability = sigmoid(logit)."""
    s = cosine_scores(T.pairs(spark, sf_dir), T.vectors(spark, sf_dir))
    return finish(s.select("row_id", (F.lit(4.0) * F.col("cosine")).alias("logit"),
                           S.sigmoid(F.lit(4.0) * F.col("cosine")).alias("prob")))


@register("entropy_binary")
def q_entropy_binary(spark, sf_dir):
    s = cosine_scores(T.pairs(spark, sf_dir), T.vectors(spark, sf_dir))
    return finish(s.select("row_id", "p", "entropy"))


@register("threshold_decision")
def q_threshold_decision(spark, sf_dir):
    sc = T.scores(spark, sf_dir)
    return finish(sc.select("row_id", "y", "p", S.decision("p").alias("y_hat")))


@register("label_masks")
def q_label_masks(spark, sf_dir):
    """Positive / negative masks: per class, count and row_id sum of the class rows."""
    p = T.pairs(spark, sf_dir)
    pos = p.where(F.col("label") == 1).agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("id_sum"))
    neg = p.where(F.col("label") == 0).agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("id_sum"))
    return (pos.select(F.lit(1).alias("label"), "n", "id_sum")
            .unionByName(neg.select(F.lit(0).alias("label"), "n", "id_sum")))


@register("label_counts")
def q_label_counts(spark, sf_dir):
    return T.pairs(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@register("filter_prefix_split")
def q_filter_prefix_split(spark, sf_dir):
    from pairlab.operators.sampling import prefix_split
    return prefix_split(T.pairs(spark, sf_dir), "antigen_name", "spike").select("row_id", "is_prefix")


# ---------------------------------------------------------------- acquisition on fixed scores
@register("acquire_entropy")
def q_acquire_entropy(spark, sf_dir):
    s = cosine_scores(T.pairs(spark, sf_dir), T.vectors(spark, sf_dir))
    return finish(A.acquire_entropy(s.select("row_id", "p"), 96).select("row_id", "p", "entropy"))


@register("acquire_short_batch")
def q_acquire_short_batch(spark, sf_dir):
    """b = min(batch, pool): the whole pool, and a batch larger than it."""
    s = cosine_scores(T.pairs(spark, sf_dir), T.vectors(spark, sf_dir))
    return finish(A.acquire_entropy(s.select("row_id", "p"), 2_000_000_000).select("row_id", "entropy"))


@register("acquire_random")
def q_acquire_random(spark, sf_dir):
    return A.acquire_random(T.pairs(spark, sf_dir).select("row_id", "label"), 96, seed=0, round_=3)


@register("initial_batch")
def q_initial_batch(spark, sf_dir):
    """First 1000 of the shuffled pool (seed 42, round 0)."""
    return A.acquire_random(T.pairs(spark, sf_dir).select("row_id", "label"), 1000, seed=42, round_=0)


# ---------------------------------------------------------------- sampling and splits
from pairlab.operators import sampling as SM  # noqa: E402


@register("stratified_split")
def q_stratified_split(spark, sf_dir):
    return SM.stratified_split(T.pairs(spark, sf_dir).select("row_id", "label"), "label", 0.2, seed=42)


@register("shuffle_split")
def q_shuffle_split(spark, sf_dir):
    return SM.shuffle_split(T.pairs(spark, sf_dir).select("row_id"), 0.2, seed=42)


@register("balanced_seed")
def q_balanced_seed(spark, sf_dir):
    s = SM.balanced_seed(T.pairs(spark, sf_dir).select("row_id", "label"), 100, seed=0)
    return s.where("selected").select("row_id", "label")


@register("subsample")
def q_subsample(spark, sf_dir):
    return SM.subsample(T.pairs(spark, sf_dir).select("row_id", "label"), 5000, seed=42)


# ---------------------------------------------------------------- metrics
from pairlab.operators import metrics as MT  # noqa: E402
from pairlab.operators import results as RS  # noqa: E402


@register("metric_accuracy")
def q_metric_accuracy(spark, sf_dir):
    return finish(MT.accuracy(T.scores(spark, sf_dir)))


@register("metric_f1")
def q_metric_f1(spark, sf_dir):
    return finish(MT.f1(T.scores(spark, sf_dir)))


@register("metric_average_precision")
def q_metric_ap(spark, sf_dir):
    return finish(MT.average_precision(T.scores(spark, sf_dir)))


@register("metric_auroc")
def q_metric_auroc(spark, sf_dir):
    return finish(MT.auroc(T.scores(spark, sf_dir)))


@register("evaluate_scores")
def q_evaluate_scores(spark, sf_dir):
    return finish(MT.evaluate_scores(T.scores(spark, sf_dir)))


@register("evaluate_scores_grouped")
def q_evaluate_scores_grouped(spark, sf_dir):
    """The same metric row per event type (one evaluation per group, all in one job)."""
    ev = T.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), "event_type",
        F.when(F.col("value") > 50, 1).otherwise(0).alias("y"),
        F.round(F.col("value") / (F.col("value") + F.lit(50.0)), 2).alias("p"))
    return finish(MT.evaluate_scores(ev, by=["event_type"]))


@register("classification_report")
def q_classification_report(spark, sf_dir):
    return finish(MT.classification_report(T.scores(spark, sf_dir)))


@register("probability_histogram")
def q_probability_histogram(spark, sf_dir):
    return finish(MT.probability_histogram(T.passes(spark, sf_dir).join(
        T.scores(spark, sf_dir).select(F.col("row_id").alias("pass"), "y"), "pass"), "p", "y", 80))


@register("learning_curve")
def q_learning_curve(spark, sf_dir):
    return finish_exact(RS.learning_curve(T.results(spark, sf_dir)))


@register("learning_curve_band")
def q_learning_curve_band(spark, sf_dir):
    r = RS.filter_results(T.results(spark, sf_dir), model="mlp_mcdropout")
    return finish(RS.learning_curve_band(r, "accuracy"))


@register("final_round")
def q_final_round(spark, sf_dir):
    return finish(RS.final_round(T.results(spark, sf_dir)))


@register("epoch_metrics")
def q_epoch_metrics(spark, sf_dir):
    return finish(MT.epoch_metrics(T.epochs(spark, sf_dir)))


@register("best_epoch")
def q_best_epoch(spark, sf_dir):
    return finish(MT.best_epoch(MT.epoch_metrics(T.epochs(spark, sf_dir))))


# ---------------------------------------------------------------- MC passes, ensembles
from pairlab.operators import mc as MC  # noqa: E402


@register("mc_mean")
def q_mc_mean(spark, sf_dir):
    return finish(MC.mc_summary(T.passes(spark, sf_dir)).select("row_id", "mean_p", "n_passes", "entropy"))


@register("mc_variance")
def q_mc_variance(spark, sf_dir):
    return finish(MC.mc_summary(T.passes(spark, sf_dir)).select("row_id", "var_p"))


@register("mc_std")
def q_mc_std(spark, sf_dir):
    return finish(MC.mc_summary(T.passes(spark, sf_dir)).select("row_id", "std_p"))


@register("acquire_mc_variance")
def q_acquire_mc_variance(spark, sf_dir):
    s = MC.mc_summary(T.passes(spark, sf_dir))
    return finish(A.top_by_score(s, "var_p", 96).select("row_id", "var_p"))


@register("ensemble_variance")
def q_ensemble_variance(spark, sf_dir):
    p = T.passes(spark, sf_dir).withColumn("model", F.col("pass") % 3)
    return finish(MC.ensemble_variance(p))


# ---------------------------------------------------------------- weights, scaling, losses
from pairlab.operators import scaling as SC  # noqa: E402


@register("class_weights")
def q_class_weights(spark, sf_dir):
    return finish(SC.class_weights(T.pairs(spark, sf_dir)))


@register("pos_weight")
def q_pos_weight(spark, sf_dir):
    return finish(SC.pos_weight(T.pairs(spark, sf_dir)))


@register("standard_scale_fit")
def q_standard_scale_fit(spark, sf_dir):
    x = FT.concat_features(lenient(spark, sf_dir))
    return finish(SC.scaler_long(SC.standard_scale_fit(x, "x")))


@register("standard_scale_apply")
def q_standard_scale_apply(spark, sf_dir):
    x = FT.concat_features(lenient(spark, sf_dir))
    st = SC.standard_scale_fit(x, "x")
    return finish(SC.standard_scale_apply(x, st, "x").select("row_id", *vec_stats("x_scaled", "xs")))


@register("bce_loss")
def q_bce_loss(spark, sf_dir):
    s = cosine_scores(T.pairs(spark, sf_dir), T.vectors(spark, sf_dir))
    pw = SC.pos_weight(s).select("pos_weight").scalar()
    return finish(s.select("row_id", S.bce_with_logits(F.lit(4.0) * F.col("cosine"), "label", pw).alias("loss")))


@register("entropy_classes")
def q_entropy_classes(spark, sf_dir):
    sc = T.scores(spark, sf_dir)
    return finish(sc.select("row_id", S.class_entropy(F.array(F.lit(1.0) - F.col("p"), F.col("p"))).alias("entropy")))


# ---------------------------------------------------------------- salience-weighted acquisition
def candidates(spark, sf_dir) -> DataFrame:
    """Strict-lookup candidates: entropy of the fixed scorer and hadamard salience."""
    looked = LK.lookup_strict(T.pairs(spark, sf_dir).select("row_id", "heavy_seq", "light_seq", "antigen_seq"),
                              T.vectors(spark, sf_dir))
    ab = looked.select("row_id", V.antibody("heavy_emb", "light_emb").alias("ab"), "antigen_emb")
    f = ab.select("row_id", V.cosine("ab", "antigen_emb").alias("cosine"),
                  V.l2norm(V.vmul("ab", "antigen_emb")).alias("salience"))
    return f.withColumn("entropy", S.binary_entropy((F.lit(1.0) + F.col("cosine")) / 2.0))


@register("salience_zscore")
def q_salience_zscore(spark, sf_dir):
    return finish(A.salience_zscore(candidates(spark, sf_dir)).select("row_id", "salience", "z"))


@register("weighted_score")
def q_weighted_score(spark, sf_dir):
    z = A.salience_zscore(candidates(spark, sf_dir))
    return finish(z.select("row_id", S.weighted_score("entropy", "z", 0.12).alias("wscore")))


@register("acquire_weighted")
def q_acquire_weighted(spark, sf_dir):
    return finish(A.acquire_weighted(candidates(spark, sf_dir), 96).select("row_id", "wscore"))


@register("acquire_hybrid")
def q_acquire_hybrid(spark, sf_dir):
    return A.acquire_hybrid(candidates(spark, sf_dir), 96, seed=1, round_=2)


# ---------------------------------------------------------------- state moves and set operators
@register("state_step")
def q_state_step(spark, sf_dir):
    """One round: labelled = balanced seed (round 0) + 96 random picks from the rest (round 1)."""
    pool = T.pairs(spark, sf_dir).select("row_id", "label")
    seeded = SM.balanced_seed(pool, 100, seed=0)
    labelled = seeded.where("selected").select("row_id", F.lit(0).alias("round"))
    unlabelled = pool.join(labelled, "row_id", "left_anti")
    pick = A.acquire_random(unlabelled, 96, seed=0, round_=1).select("row_id", F.lit(1).alias("round"))
    return labelled.unionByName(pick)


@register("pool_minus_selected")
def q_pool_minus_selected(spark, sf_dir):
    pool = T.pairs(spark, sf_dir)
    picked = A.acquire_random(pool, 1000, seed=42, round_=0)
    return LK.pool_minus_selected(pool, picked).select("row_id")


@register("gather_selected")
def q_gather_selected(spark, sf_dir):
    pool = T.pairs(spark, sf_dir)
    ids = A.acquire_random(pool.select("row_id"), 96, seed=7, round_=0)
    return LK.gather_selected(pool, ids).select("row_id", "heavy_seq", "light_seq", "antigen_seq", "label")


@register("distinct_keys")
def q_distinct_keys(spark, sf_dir):
    pool = T.pairs(spark, sf_dir)
    a = A.acquire_random(pool, 1000, seed=42, round_=0)
    b = A.acquire_random(pool, 1000, seed=42, round_=1)
    return LK.distinct_keys(a, b)


# ---------------------------------------------------------------- sources and sinks (round trips)
import uuid  # noqa: E402

from pairlab.config import state_path  # noqa: E402
from pairlab.operators import encode as EN  # noqa: E402
from pairlab.operators import geometry as GE  # noqa: E402
from pairlab.operators import tokens as TK  # noqa: E402
from pairlab.sources import readers as RD  # noqa: E402
from pairlab.sources import writers as WR  # noqa: E402


def scratch(spark, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return state_path(spark, "io", f"{name}-{uuid.uuid4().hex}")


@register("src_csv_pairs")
def q_src_csv_pairs(spark, sf_dir):
    path = scratch(spark, "pairs_csv")
    T.pairs(spark, sf_dir).write.option("header", True).csv(path)
    return RD.read_pairs_csv(spark, path)


@register("src_text_sequences")
def q_src_text_sequences(spark, sf_dir):
    path = scratch(spark, "seq_text")
    T.seqs(spark, sf_dir).select("seq").write.text(path)
    return RD.read_sequences(spark, path)


@register("src_embeddings")
def q_src_embeddings(spark, sf_dir):
    """Tensor-layout embedding parquet -> (seq, data, shape), pruned to those columns."""
    path = scratch(spark, "emb_struct")
    T.tokens(spark, sf_dir).write.parquet(path)
    e = RD.read_embeddings(spark, path)
    return finish(e.select("seq", F.col("shape"), *vec_stats("data", "data")))


@register("sink_embeddings")
def q_sink_embeddings(spark, sf_dir):
    path = scratch(spark, "emb_flat")
    WR.write_embeddings(T.emb(spark, sf_dir), path)
    e = RD.read_embeddings(spark, path)
    return finish(e.select("seq", *vec_stats("data", "data")))


@register("feature_cache_roundtrip")
def q_feature_cache_roundtrip(spark, sf_dir):
    path = scratch(spark, "features")
    WR.write_feature_cache(FT.concat_features(lenient(spark, sf_dir)), path)
    back = spark.read.parquet(path)
    return finish(back.select("row_id", "label", *vec_stats("x", "x")))


RESULTS_SCHEMA = ("model STRING, strategy STRING, seed BIGINT, round INT, n_labeled INT, accuracy DOUBLE, "
                  "f1 DOUBLE, auprc DOUBLE")


@register("results_csv_roundtrip")
def q_results_csv_roundtrip(spark, sf_dir):
    path = scratch(spark, "results_csv")
    WR.write_results_csv(T.results(spark, sf_dir), path)
    return finish(WR.read_results_csv(spark, path, RESULTS_SCHEMA))


@register("report_json")
def q_report_json(spark, sf_dir):
    path = scratch(spark, "report")
    rep = MT.epoch_metrics(T.epochs(spark, sf_dir)).select(F.col("epoch").alias("batch"),
                                                           F.lit("passive").alias("strategy"),
                                                           "val_loss", "val_acc")
    WR.write_report(rep, path)
    return finish(spark.read.schema("batch INT, strategy STRING, val_loss DOUBLE, val_acc DOUBLE").json(path))


@register("dedupe_last_wins")
def q_dedupe_last_wins(spark, sf_dir):
    """Repeated document texts: the row with the highest doc_id wins."""
    d = T.table(spark, sf_dir, "documents").select("text", "doc_id", "lang")
    r = RD.dedupe_last(d, "text", ["doc_id"])
    return r.select(F.md5("text").alias("text_md5"), "doc_id", "lang")


# ---------------------------------------------------------------- token matrices
def decoded(spark, sf_dir) -> DataFrame:
    t = T.tokens(spark, sf_dir)
    return TK.decode_tokens(t.select("text", F.col("embedding.data").cast("array<double>").alias("data"),
                                     F.col("embedding.shape").alias("shape")))


@register("decode_tokens")
def q_decode_tokens(spark, sf_dir):
    d = decoded(spark, sf_dir)
    return finish(d.select("text", F.size("tokens").alias("n_tok"),
                           V.vsum(F.element_at("tokens", 1)).alias("first_sum"),
                           V.vsum(F.element_at("tokens", -1)).alias("last_sum")))


@register("mean_pool")
def q_mean_pool(spark, sf_dir):
    d = TK.mean_pool(decoded(spark, sf_dir))
    return finish(d.select("text", *vec_stats("pooled", "pooled")))


@register("first_token_pool")
def q_first_token_pool(spark, sf_dir):
    d = TK.first_token_pool(decoded(spark, sf_dir))
    return finish(d.select("text", *vec_stats("cls", "cls")))


@register("pad_and_mask")
def q_pad_and_mask(spark, sf_dir):
    d = TK.pad_and_mask(decoded(spark, sf_dir))
    return finish(d.select("text", F.size("padded").alias("n_padded"),
                           F.size(F.filter("mask", lambda m: m)).alias("n_valid"),
                           F.aggregate("padded", F.lit(0.0), lambda acc, t: acc + V.vsum(t)).alias("padded_sum")))


@register("antibody_tokens")
def q_antibody_tokens(spark, sf_dir):
    d = decoded(spark, sf_dir)
    d = d.select("text", F.col("tokens").alias("heavy_tokens"),
                 F.when(F.size("tokens") % 2 == 0, F.reverse("tokens")).alias("light_tokens"))
    a = TK.antibody_tokens(d)
    return finish(a.select("text", F.size("ab_tokens").alias("n_tok"),
                           F.aggregate("ab_tokens", F.lit(0.0), lambda acc, t: acc + V.vsum(t)).alias("ab_sum")))


from pairlab.operators import token_lookup as TL  # noqa: E402


@register("lookup_tokens")
def q_lookup_tokens(spark, sf_dir):
    """Strict lookup of whole token matrices of three chains from a store bucketed by sequence."""
    flat = T.tokens(spark, sf_dir).select("text", "embedding.data", "embedding.shape")
    store = TL.store_tokens(TK.decode_tokens(flat, wide=False), "text", "tokens", buckets=16)
    t = TL.lookup_tokens(T.token_pairs(spark, sf_dir), store)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + V.vsum(x))
    return finish(t.select("row_id", "label", "light_status", *[F.size(f"{c}_tokens").alias(f"{c}_n") for c in ("heavy", "antigen")],
                           F.when(F.col("light_tokens").isNotNull(), F.size("light_tokens")).alias("light_n"),
                           *[total(f"{c}_tokens").alias(f"{c}_sum") for c in ("heavy", "light", "antigen")]))


def attention_weights(dim: int) -> list[float]:
    """Fixed scoring weights for the attention-pool check: ((j mod 7) - 3) / 10."""
    return [((j % 7) - 3) / 10.0 for j in range(dim)]


@register("attention_pool")
def q_attention_pool(spark, sf_dir):
    a = TK.attention_pool(decoded(spark, sf_dir), "tokens", None, attention_weights(_dim_int(spark, sf_dir)), 0.1)
    return finish(a.select("text", *vec_stats("attn_pooled", "attn")))


# ---------------------------------------------------------------- encoder job
@register("extract_embeddings")
def q_extract_embeddings(spark, sf_dir):
    s = T.seqs(spark, sf_dir)
    e = EN.extract_embeddings(s, "seq", EN.get_encoder("composition", dim=64), "embedding")
    return finish(e.select("row_id", F.length("seq").alias("n_chars"), *vec_stats("embedding", "emb")))


@register("extract_once")
def q_extract_once(spark, sf_dir):
    """The encoder job over distinct sequences, in packs of like length under a token budget."""
    e = EN.extract_once(T.seqs(spark, sf_dir), "seq", EN.get_encoder("composition", dim=64), "embedding")
    return finish(e.select("row_id", F.length("seq").alias("n_chars"), *vec_stats("embedding", "emb")))


@register("extract_tokens")
def q_extract_tokens(spark, sf_dir):
    """Per-token layout: the flat values have as many elements as the shape says."""
    e = EN.extract_embeddings(T.seqs(spark, sf_dir), "seq", EN.get_encoder("composition", dim=16), "embedding", per_token=True)
    size = F.size("embedding.data") == F.aggregate("embedding.shape", F.lit(1).cast("bigint"), lambda a, n: a * n)
    return e.select("row_id", F.length("seq").alias("n_chars"), F.coalesce(size, F.lit(True)).alias("shape_ok"))


@register("feature_pipeline")
def q_feature_pipeline(spark, sf_dir):
    """The pipeline that every study starts from, over an embedding table that was loaded twice: the second load wins."""
    path = scratch(spark, "embedding-loads")
    half = F.expr("cast(size(embedding) div 2 as bigint)")
    for load, sign in ((1, -1.0), (2, 1.0)):
        data = V.vscale("embedding", F.lit(sign))
        T.emb(spark, sf_dir).select(F.col("seq").alias("text"), F.struct(
            data.alias("data"), F.array(F.lit(2).cast("bigint"), half).alias("shape")).alias("embedding")).write.parquet(f"{path}/load={load}")
    x = FP.feature_pipeline(spark, T.pairs(spark, sf_dir), path, scratch(spark, "feature-cache"))
    return finish(x.select("row_id", "label", "heavy_seq", *vec_stats("x", "x")))


# ---------------------------------------------------------------- geometry
@register("leaf_proximity")
def q_leaf_proximity(spark, sf_dir):
    return finish(GE.leaf_proximity(T.leaves(spark, sf_dir)))


@register("proximity_totals")
def q_proximity_totals(spark, sf_dir):
    return GE.proximity_totals(T.leaves(spark, sf_dir))


@register("separability")
def q_separability(spark, sf_dir):
    """Raw [heavy | antigen] space against the forest's: scatter and centroid silhouette beside the share of co-leaf
    neighbours with the same label."""
    raw = GE.separability(strict(spark, sf_dir).select("label", F.concat("heavy_emb", "antigen_emb").alias("x")), "x")
    leaf = GE.neighbour_label_agreement(T.leaves(spark, sf_dir), T.pairs(spark, sf_dir)).agg(
        (F.sum("same_label") / F.sum("neighbours")).alias("leaf_agreement"))
    return finish(raw.withColumn("leaf_agreement", leaf.scalar()))


@register("neighbour_label_agreement")
def q_neighbour_label_agreement(spark, sf_dir):
    return finish(GE.neighbour_label_agreement(T.leaves(spark, sf_dir), T.pairs(spark, sf_dir)))


@register("nearest_to_center")
def q_nearest_to_center(spark, sf_dir):
    """Per label, the embedding closest to the label centroid."""
    e = T.emb(spark, sf_dir).withColumn("row_id", F.expr("CAST(substring(seq, 2) AS BIGINT)"))
    c = GE.class_centroids(e, "embedding", "emb_label")
    return finish(A.nearest_to_center(e, c, "embedding", "emb_label"))


@register("centroid_distance")
def q_centroid_distance(spark, sf_dir):
    e = T.emb(spark, sf_dir)
    return finish(GE.centroid_distance(e, "embedding", "emb_label").select("seq", "emb_label", "dist"))


from pairlab.operators import neighbours as NB  # noqa: E402

NEIGHBOURS = 30


def _vectors(spark, sf_dir) -> DataFrame:
    return T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("row_id"), "embedding")


@register("knn_exact")
def q_knn_exact(spark, sf_dir):
    """The 30 rows nearest by cosine to every row whose id is divisible by 20, against all rows."""
    v = _vectors(spark, sf_dir)
    return finish(NB.knn_exact(v.where("row_id % 20 = 0"), v, "embedding", NEIGHBOURS))


@register("knn_graph")
def q_knn_graph(spark, sf_dir):
    """The graph behind the layouts: for every row the number of neighbours, their ranks and cosines in order."""
    g = NB.knn_graph(_vectors(spark, sf_dir), "embedding", NEIGHBOURS)
    lists = g.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("neighbour").alias("n_distinct"), F.max("rank").alias("last_rank"),
                                F.array_sort(F.collect_list(F.struct("rank", "cosine"))).alias("l"))
    falls = F.forall(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.get("l.cosine", i - 1) >= F.get("l.cosine", i))
    return lists.select("id", "n", "n_distinct", F.col("last_rank").cast("long").alias("last_rank"),
                        (F.when(F.size("l") > 1, falls).otherwise(True)).alias("ordered"))


@register("knn_recall")
def q_knn_recall(spark, sf_dir):
    """Recall of the graph for the rows whose id is divisible by 20: at least 0.9 of the true neighbours."""
    v = _vectors(spark, sf_dir)
    asked = v.where("row_id % 20 = 0")
    path = scratch(spark, "knn-graph")
    NB.knn_graph(v, "embedding", NEIGHBOURS).write.parquet(path)
    r = NB.recall(spark.read.parquet(path).join(asked.select(F.col("row_id").alias("id")), "id", "left_semi"), NB.knn_exact(asked, v, "embedding", NEIGHBOURS))
    return r.select("true_neighbours", (F.col("recall") >= 0.9).alias("recall_ok"))


# ---------------------------------------------------------------- models
from pairlab.operators import models as M  # noqa: E402
from pairlab.plans import loop as LP  # noqa: E402


@register("mlp_forward")
def q_mlp_forward(spark, sf_dir):
    """Pair MLP (concat heavy, antigen -> 16 ReLU -> logit) with rule-defined weights."""
    d = _dim_int(spark, sf_dir)
    s = strict(spark, sf_dir).select("row_id", F.concat("heavy_emb", "antigen_emb").alias("x"))
    return finish(M.mlp_score(s, M.rule_weights([2 * d, 16, 1]), "x"))


def _frozen(spark, sf_dir):
    """Rows (row_id, x) and the pair MLP (16, 8 hidden units by rule) with both hidden layers normalised over them."""
    d = _dim_int(spark, sf_dir)
    path = scratch(spark, "frozen")  # read by two jobs a layer and by the scores: looked up once
    strict(spark, sf_dir).select("row_id", F.concat("heavy_emb", "antigen_emb").alias("x")).write.option("compression", "zstd").parquet(path)
    s = spark.read.parquet(path)
    norms = {i: M.BatchNorm(1.0 + 0.05 * np.arange(n), 0.02 * np.arange(n) - 0.1) for i, n in enumerate((16, 8))}
    return s, M.freeze_batchnorm(s, M.rule_weights([2 * d, 16, 8, 1]), norms, "x")


@register("frozen_batchnorm_score")
def q_frozen_batchnorm_score(spark, sf_dir):
    """Pair MLP with batch normalisation before both ReLUs, frozen at the moments of all rows: deterministic scores."""
    return finish(M.mlp_score(*_frozen(spark, sf_dir), "x"))


@register("frozen_batchnorm_mc")
def q_frozen_batchnorm_mc(spark, sf_dir):
    """The same network with dropout on and normalisation frozen: a row's summary over 20 passes is the same whether it
    is scored with all rows or with the few that share its hash."""
    s, w = _frozen(spark, sf_dir)
    alone = s.repartition(37, "row_id")
    a = M.mc_dropout_score(s, w, "x").select("row_id", F.col("mean_p").alias("a"), F.col("var_p").alias("v"))
    b = M.mc_dropout_score(alone, w, "x").select("row_id", F.col("mean_p").alias("b"), F.col("var_p").alias("u"))
    return a.join(b, "row_id").select("row_id", ((F.abs(F.col("a") - F.col("b")) < 1e-9) & (F.abs(F.col("v") - F.col("u")) < 1e-9)).alias("same"),
                                      F.col("a").between(0, 1).alias("in_range"), F.col("v").between(0, 0.25).alias("var_in_range"))


def features(spark, sf_dir) -> DataFrame:
    return LP.interaction_table(spark, T.pairs(spark, sf_dir), T.vectors(spark, sf_dir))


def within(c: str, lo: float, hi: float):
    """Whether a value lies in [lo, hi]; NULL and NaN do not."""
    return F.coalesce(F.col(c).between(lo, hi) & ~F.isnan(c), F.lit(False))


@register("train_mlp")
def q_train_mlp(spark, sf_dir):
    """Data-parallel full-batch training at the study's size: loss of every epoch is finite, and the last below the first."""
    data = features(spark, sf_dir)
    cfg = EngineConfig()
    _, hist = M.train_mlp(data, "x", "label", hidden=(cfg.hidden, cfg.hidden // 2), epochs=cfg.epochs, lr=cfg.lr,
                          dropout=cfg.dropout, seed=0)
    first, last = hist[0][1], hist[-1][1]
    t = spark.createDataFrame([(e, v, last < first) for e, v in hist], "epoch INT, loss DOUBLE, falls BOOLEAN")
    return t.select("epoch", within("loss", 0.0, 1e6).alias("finite"), "falls")


@register("mc_dropout_score")
def q_mc_dropout_score(spark, sf_dir):
    """20 dropout passes of a trained MLP over every row: mean, variance and entropy within their bounds."""
    data = features(spark, sf_dir)
    w, _ = M.train_mlp(data, "x", "label", hidden=(256, 128), epochs=EngineConfig().epochs, lr=1e-2, seed=0)
    s = M.mc_dropout_score(data, w, "x", passes=20, rate=0.3, seed=0)
    return s.select("row_id", within("mean_p", 0.0, 1.0).alias("mean_ok"), (F.col("var_p") <= 0.25).alias("var_ok"),
                    within("entropy", 0.0, 0.6931472).alias("entropy_ok"))


@register("train_best_epoch")
def q_train_best_epoch(spark, sf_dir):
    """Training with validation in the same passes: the kept checkpoint is that of the first epoch with the best accuracy,
    and scores the validation rows, saved and read back, with just that accuracy."""
    data = features(spark, sf_dir)
    split = SM.shuffle_split(data.select("row_id"), 0.2, 42)
    path = scratch(spark, "best-epoch")
    split.write.parquet(f"{path}-split")
    rows, cfg = SM.mark(data.select("row_id", "x", "label"), spark.read.parquet(f"{path}-split"), 42, "val"), EngineConfig()  # the features are not written again
    w, best, hist = M.train_mlp_best(rows, "val", "x", "label", hidden=(cfg.hidden, cfg.hidden // 2), epochs=cfg.epochs, lr=cfg.lr,
                                     dropout=cfg.dropout, seed=0)
    WR.save_weights(spark, w, f"{path}-checkpoint")
    scored = M.mlp_score(rows.where("val"), RD.load_weights(spark, f"{path}-checkpoint"), "x").join(rows.select("row_id", "label"), "row_id")
    acc = scored.agg(F.avg((S.decision("p") == F.col("label")).cast("double"))).first()[0]
    first = max(hist, key=lambda h: (h[3], -h[0]))
    t = spark.createDataFrame([(e, tl, vl, e == best, best == first[0] and abs(acc - first[3]) < 1e-9) for e, tl, vl, _ in hist],
                              "epoch INT, train_loss DOUBLE, val_loss DOUBLE, chosen BOOLEAN, reloaded_ok BOOLEAN")
    ok = within("train_loss", 0.0, 1e6) & within("val_loss", 0.0, 1e6)
    return t.select("epoch", ok.alias("finite"), "reloaded_ok", F.sum(F.col("chosen").cast("long")).over(Window.partitionBy()).alias("n_chosen"))


@register("train_ensemble")
def q_train_ensemble(spark, sf_dir):
    """Five networks on five bootstrap samples in the passes of one; mean, variance and entropy over them for every row."""
    data, cfg = features(spark, sf_dir), EngineConfig()
    models, _ = M.train_ensemble(data, "x", "label", k=cfg.ensemble, hidden=(cfg.hidden, cfg.hidden // 2), epochs=cfg.epochs, lr=cfg.lr,
                                 dropout=cfg.dropout, seed=0)
    s = M.ensemble_score(data, models, "x")
    return s.select("row_id", within("mean_p", 0.0, 1.0).alias("mean_ok"), within("var_p", 0.0, 0.25).alias("var_ok"),
                    within("entropy", 0.0, 0.6931472).alias("entropy_ok"))


@register("al_loop_ensemble")
def q_al_loop_ensemble(spark, sf_dir):
    """Batches of 96 by the variance over an ensemble of five networks."""
    return _progress(LP.run_al(spark, features(spark, sf_dir), "ensemble", seed=0, batch=96, rounds=1, model="ensemble"))


@register("train_forest")
def q_train_forest(spark, sf_dir):
    """Forest of study 02 (300 trees, leaves of two) on the split: every held-out row gets a probability."""
    data = features(spark, sf_dir)
    split = SM.stratified_split(data.select("row_id", "label"), "label", 0.2, seed=42)
    train, test = SM.divide(data, split, 42, ["label"])
    model = M.train_forest(train, "x", "label", num_trees=300, min_leaf=2, seed=42)
    pred = M.forest_predict(model, test.select("row_id", "label", "x"), "x")
    return pred.select("row_id", "label", within("p", 0.0, 1.0).alias("p_ok"))


@register("forest_leaf_proximity")
def q_forest_leaf_proximity(spark, sf_dir):
    """Leaf ids of a trained forest (one for each tree and row) and every row's proximity to all others, from the rows that share a leaf with it."""
    data = features(spark, sf_dir)
    model = M.train_forest(data, "x", "label", num_trees=300, min_leaf=2, seed=42)
    path = scratch(spark, "leaves")  # read for the leaves and for the proximity: walked down once
    M.forest_predict(model, data.select("row_id", "x"), "x", leaves=True).select("row_id", F.col("leaves").cast("array<int>").alias("leaves")).write.parquet(path)
    long = M.forest_leaves_long(spark.read.parquet(path))
    per = long.groupBy("row_id").agg(F.count("*").alias("n_leaves"), F.countDistinct("tree").alias("n_trees"),
                                     F.min(F.col("leaf") >= 0).alias("leaf_ok"))
    near = GE.leaf_proximity(long).withColumnRenamed("row_id", "_id")
    # a row alone has no other to be near to
    ok = (F.col("shared_leaves") >= 0) & F.coalesce(F.col("mean_proximity").between(0, 1), F.lit(True))
    return per.join(near, F.col("row_id").eqNullSafe(F.col("_id")), "left").select("row_id", "n_leaves", "n_trees", "leaf_ok", F.coalesce(ok, F.lit(False)).alias("proximity_ok"))


def _scored(data: DataFrame, n: int = 480) -> DataFrame:
    """Rows of the features whose id is among the n most uncertain rows of the fixed scorer, with its entropy; the scorer's cosine
    is the last of a row's features. The rows are chosen on ids and entropies of all, only those chosen are joined."""
    c = data.select("row_id", S.binary_entropy((F.lit(1.0) + F.element_at("x", -1)) / 2.0).alias("entropy")).where("row_id IS NOT NULL")
    return data.join(F.broadcast(A.top_by_score(c, "entropy", n)), "row_id")


def _slice(spark, data: DataFrame) -> DataFrame:
    """The 480 most uncertain rows of the fixed scorer, written once."""
    top = A.top_by_score(_scored(data), "entropy", 480)
    path = scratch(spark, "slice")
    top.select("row_id", "x", "entropy").write.parquet(path)
    return spark.read.parquet(path)


@register("kmeans_slice")
def q_kmeans_slice(spark, sf_dir):
    """KMeans(96) on the 480 most uncertain rows of the fixed scorer: each gets a cluster."""
    top = _slice(spark, features(spark, sf_dir))
    km = M.kmeans_best(top, "x", 96, seed=42)
    from pyspark.ml.functions import array_to_vector
    out = km.transform(top.withColumn("_v", array_to_vector("x")))
    return out.select("row_id", F.col("cluster").between(0, 95).alias("cluster_ok"))


@register("acquire_badge")
def q_acquire_badge(spark, sf_dir):
    """BADGE batch: at most 96 distinct ids, all from the 480 most uncertain rows."""
    data = features(spark, sf_dir)
    top = _slice(spark, data)
    got = LP.acquire_badge(_scored(data).select("row_id", "x", "entropy"), "x", 96, seed=42)
    got = got.join(top.select("row_id", F.lit(True).alias("inside")), "row_id", "left")
    return got.agg(F.count("*").between(1, 96).alias("size_ok"), (F.count("*") == F.countDistinct("row_id")).alias("distinct"),
                   F.min(F.coalesce("inside", F.lit(False))).alias("inside"))


@register("project_2d")
def q_project_2d(spark, sf_dir):
    """PCA plane of the scaled features: centred, uncorrelated axes, the first with the larger variance."""
    data = features(spark, sf_dir)
    st = SC.standard_scale_fit(data, "x")
    scaled = SC.standard_scale_apply(data, st, "x", "xs")
    p = GE.project_2d(scaled.select("row_id", "label", "xs"), "xs").select(F.col("xy")[0].alias("a"), F.col("xy")[1].alias("b"))
    return p.agg(F.count("*").alias("n"), (F.abs(F.avg("a")) < 1e-6).alias("mean_a"), (F.abs(F.avg("b")) < 1e-6).alias("mean_b"),
                 (F.abs(F.corr("a", "b")) < 1e-6).alias("uncorrelated"), (F.var_pop("a") >= F.var_pop("b")).alias("ordered"))


@register("project_sketch")
def q_project_sketch(spark, sf_dir):
    """The plane of ``project_2d`` from a randomised sketch: centred, uncorrelated axes, the first with the larger variance."""
    data = features(spark, sf_dir)
    path = scratch(spark, "scaled")
    SC.standard_scale_apply(data, SC.standard_scale_fit(data, "x"), "x", "xs").select("row_id", "xs").write.parquet(path)
    p = GE.project_sketch(spark.read.parquet(path), "xs").select(F.col("xy")[0].alias("a"), F.col("xy")[1].alias("b"))
    return p.agg(F.count("*").alias("n"), (F.abs(F.avg("a")) < 1e-6).alias("mean_a"), (F.abs(F.avg("b")) < 1e-6).alias("mean_b"),
                 (F.abs(F.corr("a", "b")) < 1e-6).alias("uncorrelated"), (F.var_pop("a") >= F.var_pop("b")).alias("ordered"))


# ---------------------------------------------------------------- loops
from pairlab.config import EngineConfig  # noqa: E402


def _progress(r: DataFrame) -> DataFrame:
    """What a loop's result must be whatever the model learned: rows, labelled and left counts, metrics in bounds."""
    ok = [within(c, 0.0, 1.0) for c in ("accuracy", "f1", "auprc", "auroc")]
    return r.select("model", "strategy", "seed", "batch_size", "round", "n_labeled", "pool_left",
                    (ok[0] & ok[1] & ok[2] & ok[3]).alias("metrics_ok"))


@register("al_loop_fixed")
def q_al_loop_fixed(spark, sf_dir):
    """Fixed horizon of study 05: 25 batches of 96 by forest entropy."""
    return _progress(LP.run_al(spark, features(spark, sf_dir), "uncertainty", seed=0, batch=96, rounds=25))


@register("al_loop_exhaust")
def q_al_loop_exhaust(spark, sf_dir):
    """Random batches of 2,000 until the pool is empty."""
    return _progress(LP.run_al(spark, features(spark, sf_dir), "random", seed=0, batch=2000))


@register("al_loop_mlp")
def q_al_loop_mlp(spark, sf_dir):
    """MC-dropout MLP loop with the salience-weighted rule of study 05."""
    return _progress(LP.run_al(spark, features(spark, sf_dir), "weighted", seed=0, batch=96, rounds=1, model="mlp"))


@register("al_loop_hybrid")
def q_al_loop_hybrid(spark, sf_dir):
    """MC-dropout MLP loop with the half-random rule of study 06."""
    return _progress(LP.run_al(spark, features(spark, sf_dir), "hybrid", seed=1, batch=96, rounds=1, model="mlp"))


@register("al_loop_badge")
def q_al_loop_badge(spark, sf_dir):
    """MC-dropout MLP loop with the diversity rule of study 07: a batch may be short."""
    r = LP.run_al(spark, features(spark, sf_dir), "badge", seed=0, batch=24, rounds=1, model="mlp")
    return r.select("model", "strategy", "round", F.when(F.col("round") == 0, F.col("n_labeled") == 100)
                    .otherwise(F.col("n_labeled").between(101, 124)).alias("size_ok"))


@register("al_campaign")
def q_al_campaign(spark, sf_dir):
    """Warm campaign: 1000 initial, 21 iterations of 96 passive picks, forest retrained each time."""
    r = LP.run_campaign(spark, features(spark, sf_dir), "passive", 96, 1000, 21)
    return r.select("batch", "strategy", "n_labeled", within("val_loss", 0.0, 100.0).alias("loss_ok"),
                    within("val_acc", 0.0, 1.0).alias("acc_ok"), (F.col("pool_left") >= 0).alias("left_ok"))


@register("experiment_grid")
def q_experiment_grid(spark, sf_dir):
    """Five seeds by two strategies, a batch each."""
    return _progress(LP.experiment_grid(spark, features(spark, sf_dir), seeds=range(5), strategies=("random", "weighted"), rounds=1))


@register("forest_roundtrip")
def q_forest_roundtrip(spark, sf_dir):
    """A forest of 200 trees on the balanced seed set, saved and read back: both give every row the same probability."""
    data = features(spark, sf_dir)
    seed = SM.balanced_seed(data.select("row_id", "label"), EngineConfig().seed_size, 0).where("selected").select("row_id")
    path = scratch(spark, "forest")
    data.join(seed, "row_id", "left_semi").write.parquet(f"{path}-rows")  # read once a level
    model = M.train_forest(spark.read.parquet(f"{path}-rows"), "x", num_trees=200, seed=0)
    WR.save_forest(model, path, trees=200)
    again, facts = RD.load_forest(spark, path)
    first = M.forest_predict(model, data.select("row_id", "x"), "x", keep_x=True).withColumnRenamed("p", "first")
    both = M.forest_predict(again, first.select("row_id", "x", "first"), "x")
    return both.select("row_id", (F.col("p") == F.col("first")).alias("same"), F.lit(facts["trees"]).alias("trees"))


@register("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    """Save the pair-MLP weights, reload them, score with the reloaded copy."""
    d = _dim_int(spark, sf_dir)
    path = scratch(spark, "model")
    WR.save_weights(spark, M.rule_weights([2 * d, 16, 1]), path)
    s = strict(spark, sf_dir).select("row_id", F.concat("heavy_emb", "antigen_emb").alias("x"))
    return finish(M.mlp_score(s, RD.load_weights(spark, path), "x"))
