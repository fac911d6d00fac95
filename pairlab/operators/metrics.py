"""Evaluation metrics as aggregations.

Ranking metrics (average precision, AUROC) need running sums over scores in descending
order. A single global window would pull every distinct score into one task, so the
scores are first collapsed to distinct values (map-side combined), then cut into ~256
range buckets using approximate quantiles (``percentile_approx``: a bounded array per
group; as many as the session has shuffle partitions, where that is more), bucket totals give each
bucket's offset (a table of at most groups x buckets rows), and the running sums are windows *within* a bucket only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.functions.scores import decision

BUCKETS = 256


def _distinct_scores(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    yy = F.col(y).cast("long")
    df = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())  # a row without a score or label is not ranked
    # NaN is no score either; left out behind the sums, as a filter on the score would compute a model's score twice
    yy = F.when(F.isnan(p), 0).otherwise(yy), F.when(F.isnan(p), 0).otherwise(1 - yy)
    d = df.groupBy(*by, F.col(p).alias("_s")).agg(F.sum(yy[0]).alias("_pos"), F.sum(yy[1]).alias("_neg"))
    return d.where(F.col("_pos") + F.col("_neg") > 0)


def running_counts(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | tuple = (),
                   buckets: int | None = None) -> DataFrame:
    """One row per (group, distinct score): pos, neg, and cumulative counts of scores >= it.

    Output columns: by..., _s, _pos, _neg, _ctp, _cfp, _P, _N. Without groups a constant
    key stands in, so the per-group bounds are one small aggregate joined back (a
    broadcast of one row), computed once.
    """
    buckets = buckets or max(BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = list(by) or ["_g"]
    src = df if by else df.withColumn("_g", F.lit(0))
    d = _distinct_scores(src, y, p, keys)
    probs = [i / buckets for i in range(1, buckets)]
    bounds = d.groupBy(*keys).agg(F.percentile_approx("_s", probs, 10 * buckets).alias("_bounds"),
                                  F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    d = d.join(bounds, keys)
    # bucket 0 holds the highest scores: count of bounds strictly above the score
    d = d.withColumn("_bk", F.size(F.filter("_bounds", lambda b: b > F.col("_s")))).drop("_bounds")
    tot = d.groupBy(*keys, "_bk").agg(F.sum("_pos").alias("_bp"), F.sum("_neg").alias("_bn"))
    wg = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, "_bk", F.coalesce(F.sum("_bp").over(wg), F.lit(0)).alias("_op"),
                     F.coalesce(F.sum("_bn").over(wg), F.lit(0)).alias("_on"))
    d = d.join(tot, [*keys, "_bk"])
    wb = Window.partitionBy(*keys, "_bk").orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = (d.withColumn("_ctp", F.col("_op") + F.sum("_pos").over(wb))
            .withColumn("_cfp", F.col("_on") + F.sum("_neg").over(wb))
            .drop("_op", "_on", "_bk"))
    return out if by else out.drop("_g")


def average_precision(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    """AP = sum over distinct thresholds (highest first) of recall step x precision."""
    r = running_counts(df, y, p, by)
    prec = F.col("_ctp") / (F.col("_ctp") + F.col("_cfp"))
    return r.groupBy(*by).agg(F.try_divide(F.sum(F.col("_pos") * prec), F.first("_P").cast("double"))
                              .alias("average_precision"))


def auroc(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    """Area under ROC with ties counted half; NULL when only one class is present."""
    r = running_counts(df, y, p, by)
    below = F.col("_N") - F.col("_cfp") + F.lit(0.5) * F.col("_neg")
    return r.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("_pos") * below), (F.first("_P") * F.first("_N")).cast("double")).alias("auroc"))


def confusion(df: DataFrame, y: str = "y", p: str = "p", by=(), threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn counts of the thresholded decision, per group; NaN is no score and decides nothing."""
    yh = F.when(~F.isnan(p), decision(p, threshold))
    yy = F.col(y)
    return df.groupBy(*by).agg(
        F.count_if((yy == 1) & (yh == 1)).alias("tp"), F.count_if((yy == 0) & (yh == 1)).alias("fp"),
        F.count_if((yy == 1) & (yh == 0)).alias("fn"), F.count_if((yy == 0) & (yh == 0)).alias("tn"))


def _f1(tp, fp, fn):
    den = F.lit(2) * tp + fp + fn
    return F.when(den == 0, F.lit(0.0)).otherwise((F.lit(2.0) * tp) / den)


def accuracy(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    c = confusion(df, y, p, by)
    return c.select(*by, ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
                    .alias("accuracy"))


def f1(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    c = confusion(df, y, p, by)
    return c.select(*by, _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def evaluate_scores(df: DataFrame, y: str = "y", p: str = "p", by=(), threshold: float = 0.5) -> DataFrame:
    """accuracy, f1 (zero_division=0), average precision, AUROC and n, one row per group.

    One pass: the confusion counts at the threshold are read off the same per-score
    running-count table that gives the ranking metrics.
    """
    by = list(by)
    r = running_counts(df, y, p, by)
    at = F.col("_s") >= F.lit(threshold)
    g = r.groupBy(*by).agg(
        F.sum(F.when(at, F.col("_pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(at, F.col("_neg")).otherwise(0)).alias("fp"),
        F.first("_P").alias("P"), F.first("_N").alias("N"),
        F.sum(F.col("_pos") * F.col("_ctp") / (F.col("_ctp") + F.col("_cfp"))).alias("_ap"),
        F.sum(F.col("_pos") * (F.col("_N") - F.col("_cfp") + F.lit(0.5) * F.col("_neg"))).alias("_auc"))
    tp, fp, P, N = F.col("tp"), F.col("fp"), F.col("P"), F.col("N")
    fn, tn = P - tp, N - fp
    return g.select(*by, (P + N).alias("n"), ((tp + tn) / (P + N)).alias("accuracy"), _f1(tp, fp, fn).alias("f1"),
                    F.try_divide(F.col("_ap"), P.cast("double")).alias("auprc"),
                    F.try_divide(F.col("_auc"), (P * N).cast("double")).alias("auroc"))


def classification_report(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted averages.

    Computed from the four confusion counts (one aggregate row), unpivoted with ``stack``.
    """
    c = confusion(df, y, p)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))

    def prf(t, f_p, f_n):
        prec = F.when(t + f_p == 0, F.lit(0.0)).otherwise(t / (t + f_p))
        rec = F.when(t + f_n == 0, F.lit(0.0)).otherwise(t / (t + f_n))
        return prec, rec, _f1(t, f_p, f_n)

    p1, r1, f1_ = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s1 + s0
    c = c.select(p0.alias("p0"), r0.alias("r0"), f0.alias("f0"), s0.alias("s0"),
                 p1.alias("p1"), r1.alias("r1"), f1_.alias("f1"), s1.alias("s1"), n.alias("n"),
                 ((tp + tn) / n).alias("acc"))
    return c.selectExpr(
        "stack(5, "
        "'0', p0, r0, f0, s0, "
        "'1', p1, r1, f1, s1, "
        "'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), acc, n, "
        "'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n, "
        "'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n"
        ") AS (class, precision, recall, f1_score, support)")


def probability_histogram(df: DataFrame, p: str = "p", label: str = "y", bins: int = 80) -> DataFrame:
    """Density histogram per label over that label's observed range; last bin closed.

    A constant column uses the range (v - 0.5, v + 0.5), as numpy does.
    """
    rng = df.groupBy(label).agg(F.min(p).alias("_lo0"), F.max(p).alias("_hi0"), F.count(F.lit(1)).alias("_n"))
    rng = rng.select(label, "_n",
                     F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
                     F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    d = df.select(label, p).join(rng, label)   # one row per label
    w = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = F.least(F.floor((F.col(p) - F.col("_lo")) / w), F.lit(bins - 1)).cast("int")
    h = d.groupBy(label, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"),
                                             F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
                                             F.first("_n").alias("_n"))
    w2 = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    return h.select(label, "bin", (F.col("_lo") + F.col("bin") * w2).alias("bin_lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * w2).alias("bin_hi"), "count",
                    (F.col("count") / (F.col("_n") * w2)).alias("density"))


def epoch_metrics(partials: DataFrame, by: str = "epoch") -> DataFrame:
    """All-reduce of per-worker partial sums: sample-weighted mean loss and accuracy (0 if empty)."""
    g = partials.groupBy(by).agg(F.sum("loss_sum").alias("_l"), F.sum("correct").alias("_c"),
                                 F.sum("n").alias("_n"))
    return g.select(by, F.when(F.col("_n") > 0, F.col("_l") / F.col("_n")).otherwise(F.lit(0.0)).alias("val_loss"),
                    F.when(F.col("_n") > 0, F.col("_c") / F.col("_n")).otherwise(F.lit(0.0)).alias("val_acc"),
                    F.col("_n").alias("n"))


def best_epoch(metrics: DataFrame, by=(), epoch: str = "epoch", score: str = "val_acc") -> DataFrame:
    """First epoch with the highest score: max of struct(score, -epoch)."""
    m = metrics.groupBy(*by).agg(F.max(F.struct(F.col(score), (-F.col(epoch)).alias("_ne"),
                                                F.struct(*[c for c in metrics.columns])
                                                .alias("_row"))).alias("_m"))
    return m.select("_m._row.*")
