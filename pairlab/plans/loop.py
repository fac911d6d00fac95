"""The acquire-train-evaluate loop, the warm campaign, and experiment grids.

State lives in tables, not in driver memory: the labelled set is a (row_id, round) table under
the session's checkpoint folder that every round adds one partition to, so lineage stays one round
deep, a lost executor only recomputes the current round, and a killed run goes on behind its last round. The driver holds only the
per-round metric rows (a handful of numbers) and the model weights.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlab.config import DEFAULT, EngineConfig, state_path
from pairlab.functions import scores as S
from pairlab.functions import vectors as V
from pairlab.operators import acquire as A
from pairlab.operators import metrics as MT
from pairlab.operators import models as M
from pairlab.operators import sampling as SM
from pairlab.operators import scaling as SC
from pairlab.operators.lookup import gather_selected, lookup_strict, pool_minus_selected
from pairlab.sources import readers as RD
from pairlab.sources import writers as WR


def _save(df: DataFrame, spark: SparkSession, *parts: str) -> DataFrame:
    path = state_path(spark, *parts)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def interaction_table(spark: SparkSession, pairs: DataFrame, emb: DataFrame, run: str | None = None) -> DataFrame:
    """(row_id, the three sequences, label, x, salience): interaction features of the strict lookup, written once."""
    keys = ("heavy_seq", "light_seq", "antigen_seq")
    looked = lookup_strict(pairs.select("row_id", *keys, "label"), emb)
    ab = looked.select("row_id", *keys, "label", V.antibody("heavy_emb", "light_emb").alias("ab"),
                       F.col("antigen_emb").alias("ag"))
    f = ab.select("row_id", *keys, "label", V.vmul("ab", "ag").alias("had"), V.vabs_diff("ab", "ag").alias("ad"),
                  V.cosine("ab", "ag").alias("cos"))
    out = f.select("row_id", *keys, "label", F.concat("had", "ad", F.array("cos")).alias("x"),
                   V.l2norm("had").alias("salience"))
    path = state_path(spark, "features", run or uuid.uuid4().hex)
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- one model fit + scoring
class Learner:
    """A scaler and a model fitted on ``train``; ``score(df)`` adds p, entropy (and var_p for the MLP) to the rows,
    keeping ``keep`` columns, so that no later step joins scores back."""

    def __init__(self, kind: str, train: DataFrame, x: str, cfg: EngineConfig, seed: int, round_: int,
                 scaler: DataFrame | None = None, forest_trees: int | None = None, min_leaf: int = 1,
                 epochs: int | None = None, val: DataFrame | None = None):
        if kind not in SCORERS:
            raise ValueError(f"unknown model {kind!r}; choose from: {', '.join(sorted(SCORERS))}")
        self.kind, self.x, self.cfg, self.seed, self.round, self.scaler = kind, x, cfg, seed, round_, scaler
        self.trees, self.min_leaf, self.epochs = forest_trees or cfg.forest_trees, min_leaf, epochs or cfg.epochs
        self.fit, self.apply = SCORERS[kind]
        self.val, self.best_epoch = val, None
        self.model = self.fit(self, self.scaled(train))

    def scaled(self, df: DataFrame) -> DataFrame:
        return df if self.scaler is None else SC.standard_scale_apply(df, self.scaler, self.x, self.x)

    def score(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return self.apply(self, self.scaled(df.select("row_id", self.x, *[c for c in keep if c != self.x])), keep)


def _fit_forest(learner: Learner, train: DataFrame):
    return M.train_forest(train, learner.x, "label", num_trees=learner.trees, seed=learner.seed,
                          min_leaf=learner.min_leaf, max_depth=learner.cfg.forest_depth)


def _score_forest(learner: Learner, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    p = M.forest_predict(learner.model, df, learner.x, keep_x=learner.x in keep)
    return p.withColumn("entropy", S.class_entropy(F.array(F.lit(1.0) - F.col("p"), F.col("p"))))


def _fit_mlp(learner: Learner, train: DataFrame):
    """With validation rows the epoch that is best on them, else the last."""
    if learner.val is not None:
        cols = ("row_id", learner.x, "label")
        both = train.select(*cols, F.lit(False).alias("val")).unionByName(learner.scaled(learner.val.select(*cols)).withColumn("val", F.lit(True)))
        both = _save(both, train.sparkSession, f"fit-{uuid.uuid4().hex}")  # read once an epoch
        model, learner.best_epoch, _ = M.train_mlp_best(
            both, "val", learner.x, "label", hidden=(learner.cfg.hidden, learner.cfg.hidden // 2), epochs=learner.epochs, lr=learner.cfg.lr,
            dropout=learner.cfg.dropout, seed=learner.seed + learner.round)
        return model
    model, _ = M.train_mlp(train, learner.x, "label", hidden=(learner.cfg.hidden, learner.cfg.hidden // 2),
                           epochs=learner.epochs, lr=learner.cfg.lr, dropout=learner.cfg.dropout,
                           seed=learner.seed + learner.round)
    return model


def _score_mlp(learner: Learner, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    s = M.mc_dropout_score(df, learner.model, learner.x, learner.cfg.mc_passes, learner.cfg.dropout,
                           seed=learner.seed * 1000 + learner.round, keep=keep)
    return s.withColumnRenamed("mean_p", "p")


def _fit_ensemble(learner: Learner, train: DataFrame):
    models, _ = M.train_ensemble(train, learner.x, "label", k=learner.cfg.ensemble, hidden=(learner.cfg.hidden, learner.cfg.hidden // 2),
                                 epochs=learner.epochs, lr=learner.cfg.lr, dropout=learner.cfg.dropout, seed=learner.seed + learner.round)
    return models


def _score_ensemble(learner: Learner, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return M.ensemble_score(df, learner.model, learner.x, keep=keep).withColumnRenamed("mean_p", "p")


#: Scorer registry: name -> (fit, score); add an entry to use another model in every loop.
SCORERS = {"forest": (_fit_forest, _score_forest), "mlp": (_fit_mlp, _score_mlp), "ensemble": (_fit_ensemble, _score_ensemble)}


def _evaluate(learner: Learner, test: DataFrame) -> dict:
    r = MT.evaluate_scores(learner.score(test, ("label",)), "label", "p").first()
    return {k: (None if r[k] is None else float(r[k])) for k in ("accuracy", "f1", "auprc", "auroc")}


STRATEGIES = ("random", "uncertainty", "weighted", "hybrid", "badge", "ensemble")


def acquire(strategy: str, unl: DataFrame, learner: Learner, b: int, seed: int, round_: int,
            cfg: EngineConfig, run: str | None = None) -> DataFrame:
    """Ids of the next batch from the unlabelled rows ``unl`` (row_id, x, salience).

    The scored candidates are written once a round: rules that read them several times do not score again.
    """
    if strategy == "random":
        return A.acquire_random(unl.select("row_id"), b, seed, round_)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; choose from: {', '.join(STRATEGIES)}")
    if strategy == "uncertainty":
        return A.top_by_score(learner.score(unl), "entropy", b).select("row_id")
    if strategy == "ensemble":
        if learner.kind != "ensemble":
            raise ValueError("the ensemble strategy ranks by the variance over models: it needs the ensemble")
        return A.top_by_score(learner.score(unl), "var_p", b).select("row_id")
    if strategy == "badge":
        return acquire_badge(learner.score(unl, (learner.x,)).select("row_id", "entropy", learner.x), learner.x, b, seed)
    scored = learner.score(unl, ("salience",)).select("row_id", "entropy", "salience")
    scored = _save(scored, unl.sparkSession, run or f"acquire-{uuid.uuid4().hex}", f"scored-{round_}")
    if strategy == "weighted":
        return A.acquire_weighted(scored, b, w=cfg.salience_weight).select("row_id")
    return A.acquire_hybrid(scored, b, seed, round_, w=cfg.salience_weight).select("row_id")


def acquire_badge(scored: DataFrame, x: str, b: int, seed: int = 42) -> DataFrame:
    """Top min(5b, n) by entropy, KMeans(b) on that slice, the member nearest each centre.

    The slice is bounded by 5b rows. Empty clusters are skipped, so fewer than b ids may
    come back, as in the reference.
    """
    spark = scored.sparkSession
    top = A.top_by_score(scored, "entropy", 5 * b)
    top = _save(top.select("row_id", x), spark, "badge", uuid.uuid4().hex)
    n = top.count()
    k = min(b, n)
    if k < 2:
        return top.select("row_id")
    km = M.kmeans_best(top, x, k, seed)
    from pyspark.ml.functions import array_to_vector
    assigned = km.transform(top.withColumn("_v", array_to_vector(x))).select("row_id", x, "cluster")
    centers = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(km.clusterCenters())],
                                    "cluster INT, center ARRAY<DOUBLE>")   # k <= b rows
    return A.nearest_to_center(assigned, centers, x, "cluster").select("row_id")


class LoopState:
    """Tables of one run: ``split``, ``scaler``, and ``labelled`` and ``metrics`` with a partition for each round.

    A round is added as a partition of its own, nothing is written twice; a part counts once its writer has put ``_SUCCESS``.
    """

    def __init__(self, spark: SparkSession, run: str):
        self.spark, self.root = spark, state_path(spark, "loops", run)

    def has(self, part: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def once(self, part: str, make) -> DataFrame:
        """The table ``part``, made and written if it is not there yet (a torn one is written anew)."""
        if not self.has(part):
            make().write.mode("overwrite").parquet(f"{self.root}/{part}")
        return self.spark.read.parquet(f"{self.root}/{part}")

    def labelled(self, upto: int) -> DataFrame:
        """(row_id, round) of the rows labelled up to a round; only the partitions of these rounds are listed and read."""
        return (self.spark.read.option("basePath", f"{self.root}/labelled").schema("row_id BIGINT, round INT")
                .parquet(*[f"{self.root}/labelled/round={r}" for r in range(upto + 1)]))


METRIC_SCHEMA = ("model STRING, strategy STRING, seed INT, batch_size INT, round INT, n_labeled BIGINT, pool_left BIGINT, "
                 "accuracy DOUBLE, f1 DOUBLE, auprc DOUBLE, auroc DOUBLE")


def run_al(spark: SparkSession, data: DataFrame, strategy: str, seed: int = 0, batch: int = 96,
           rounds: int | None = None, model: str = "forest", cfg: EngineConfig = DEFAULT,
           forest_trees: int | None = None, epochs: int | None = None, x: str = "x", min_leaf: int = 1,
           run: str | None = None) -> DataFrame:
    """Stratified split -> scaler fitted on the pool -> balanced cold start -> rounds of (train, evaluate, acquire).

    ``rounds=None`` runs until the pool is exhausted; otherwise at most ``rounds`` batches are acquired
    (rounds + 1 rows), and ``pool_left`` tells how many rows were never labelled. A run that is given its name (``run``)
    again with the same arguments goes on behind its last complete round and ends with the same table.
    """
    run = run or f"run-{uuid.uuid4().hex}"
    state = LoopState(spark, run)
    split = state.once("split", lambda: SM.stratified_split(data.select("row_id", "label"), "label", cfg.test_fraction, seed))
    pool, test = SM.divide(data, split, seed, ["label"])
    scaler = state.once("scaler", lambda: SC.standard_scale_fit(pool, x))
    state.once("labelled/round=0", lambda: SM.balanced_seed(split.where(~F.col("is_test")).select("row_id", "label"), cfg.seed_size, seed)
               .where("selected").select("row_id"))
    total = split.where(~F.col("is_test")).count()
    rows, r = [], 0
    while True:
        labelled = state.labelled(r)
        learner = None

        def learned() -> Learner:
            # read once an epoch or level: written, so that the pool is scanned once a fit
            train = _save(pool.join(labelled.select("row_id"), "row_id", "left_semi"), spark, "loops", run, "train")
            return Learner(model, train, x, cfg, seed, r, scaler, forest_trees, min_leaf, epochs)

        if not state.has(f"metrics/round={r}"):
            learner = learned()
            n_lab = labelled.count()
            row = {"model": model, "strategy": strategy, "seed": seed, "batch_size": batch, "round": r,
                   "n_labeled": n_lab, "pool_left": total - n_lab, **_evaluate(learner, test)}
            state.once(f"metrics/round={r}", lambda: spark.createDataFrame([row], METRIC_SCHEMA).coalesce(1))
        rows.append(spark.read.schema(METRIC_SCHEMA).parquet(f"{state.root}/metrics/round={r}").first())
        if rows[-1]["n_labeled"] >= total or r == rounds:
            break
        if not state.has(f"labelled/round={r + 1}"):
            unl = pool.join(labelled.select("row_id"), "row_id", "left_anti")
            state.once(f"labelled/round={r + 1}", lambda: acquire(strategy, unl, learner or learned(), batch, seed, r, cfg, f"{run}-{uuid.uuid4().hex}")
                       .select("row_id"))
        r += 1
    return spark.createDataFrame(rows, METRIC_SCHEMA)


def experiment_grid(spark: SparkSession, data: DataFrame, seeds, strategies, models=("forest",),
                    batches=(96,), rounds: int | None = None, parallel: int = 4, **kw) -> DataFrame:
    """Every (seed, strategy, model, batch) run, ``parallel`` at a time, results in one table.

    The runs share nothing but ``data``; the driver only submits their jobs from threads.
    """
    from concurrent.futures import ThreadPoolExecutor
    from itertools import product

    runs = list(product(seeds, strategies, models, batches))
    with ThreadPoolExecutor(parallel) as pool:
        tables = list(pool.map(lambda c: run_al(spark, data, c[1], c[0], c[3], rounds, c[2], **kw), runs))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def run_campaign(spark: SparkSession, data: DataFrame, strategy: str = "passive", query_size: int = 96,
                 initial: int = 1000, iterations: int = 21, model: str = "forest",
                 cfg: EngineConfig = DEFAULT, forest_trees: int | None = None, x: str = "x",
                 report_uri: str | None = None) -> DataFrame:
    """Warm campaign: shuffled 80/20 split (seed 42), the first ``initial`` train rows, then
    ``iterations`` rounds of +query_size picks, retraining from scratch on all picks each time.

    A picked row takes every pool row with the same (heavy, light, antigen) triple out of the pool.
    ``mc_dropout`` ranks by the variance over the passes and so needs the MLP. Report rows: (batch,
    strategy, val_loss, val_acc, n_labeled, pool_left, best_epoch, is_best); a network scores and picks with the
    checkpoint of its best epoch on the validation rows; with ``report_uri`` the report is
    written there as JSON, and the MLP of the best batch (highest val_acc, first of equals) beside it.
    """
    if strategy not in ("passive", "mc_dropout"):
        raise ValueError(f"unknown campaign strategy {strategy!r}; choose from: passive, mc_dropout")
    if strategy == "mc_dropout" and model != "mlp":
        raise ValueError("mc_dropout needs the mlp: a forest has no dropout passes")
    run = f"campaign-{uuid.uuid4().hex}"
    keys = ["heavy_seq", "light_seq", "antigen_seq"]
    split = _save(SM.shuffle_split(data.select("row_id"), 0.2, 42), spark, run, "split")
    train, val = SM.divide(data, split, 42, test_first=False)
    scaler = _save(SC.standard_scale_fit(train, x), spark, run, "scaler")
    ids = train.select("row_id", *keys)
    selected = _save(gather_selected(ids, A.acquire_random(ids.select("row_id"), initial, 42, 0)), spark, run, "sel-0")
    report, best = [], None

    def fitted(it: int) -> Learner:
        """Trained from scratch on all picks; a network is the one of its best epoch on the validation rows, read back."""
        rows = _save(train.join(selected.select("row_id"), "row_id", "left_semi"), spark, run, "picked")
        learner = Learner(model, rows, x, cfg, 42, it, scaler, forest_trees, val=val if model == "mlp" else None)
        if model == "mlp":
            path = state_path(spark, run, f"checkpoint-{it}")
            WR.save_weights(spark, learner.model, path)
            learner.model = RD.load_weights(spark, path)
        return learner

    learner = fitted(0)
    for it in range(1, iterations + 1):
        left = pool_minus_selected(ids, selected)
        if left.isEmpty():
            break
        if strategy == "passive":
            pick = A.acquire_random(left.select("row_id"), query_size, 42, it)
        else:
            s = learner.score(train).join(left.select("row_id"), "row_id", "left_semi")  # narrow rows are joined
            pick = A.top_by_score(s, "var_p", query_size).select("row_id")
        selected = _save(selected.unionByName(gather_selected(ids, pick)), spark, run, f"sel-{it}")
        learner = fitted(it)
        scored = learner.score(val, ("label",))
        logit = F.log(F.col("p") + 1e-12) - F.log(1 - F.col("p") + 1e-12)
        r = scored.agg(F.avg(S.bce_with_logits(logit, "label")).alias("val_loss"),
                       F.avg((S.decision("p") == F.col("label")).cast("double")).alias("val_acc")).first()
        report.append({"batch": it, "strategy": strategy, "val_loss": float(r["val_loss"]), "val_acc": float(r["val_acc"]),
                       "n_labeled": selected.count(), "pool_left": pool_minus_selected(ids, selected).count(), "best_epoch": learner.best_epoch})
        if best is None or report[-1]["val_acc"] > best[0]:
            best = (report[-1]["val_acc"], it)
            if model == "mlp" and report_uri:
                WR.save_weights(spark, learner.model, f"{report_uri}/model")
    rows = [r | {"is_best": r["batch"] == best[1]} for r in report] if best else []
    out = spark.createDataFrame(rows, schema="batch INT, strategy STRING, val_loss DOUBLE, val_acc DOUBLE, "
                                             "n_labeled BIGINT, pool_left BIGINT, best_epoch INT, is_best BOOLEAN")
    if report_uri:
        WR.write_report(out, f"{report_uri}/report")
    return out
