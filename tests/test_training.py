"""Validation in the training passes, bootstrap ensembles, the ensemble strategy, checkpoints in the campaign."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.config import EngineConfig
from pairlab.operators import models as M
from pairlab.plans import loop as LP
from tests.test_operators import _toy

SMALL = EngineConfig(hidden=8, epochs=4, lr=0.05, mc_passes=3, ensemble=3)


def accuracy(weights, rows):
    z = M.forward(weights, np.array([r.x for r in rows]))
    return float(((z >= 0) == (np.array([r.label for r in rows]) == 1)).mean())


def test_best_epoch_is_the_first_best_and_its_weights_are_kept(spark):
    df = _toy(spark).withColumn("val", F.col("row_id") % 4 == 0)
    w, best, hist = M.train_mlp_best(df, "val", "x", hidden=(8, 4), epochs=6, lr=0.05, dropout=0.2, seed=3)
    assert [h[0] for h in hist] == [1, 2, 3, 4, 5, 6]
    accs = [h[3] for h in hist]
    assert best == accs.index(max(accs)) + 1
    assert accuracy(w, df.where("val").collect()) == pytest.approx(max(accs))


def test_validation_rows_are_not_learned_from(spark):
    df = _toy(spark).withColumn("val", F.col("row_id") % 4 == 0)
    plain, hist = M.train_mlp(df.where("not val"), "x", hidden=(8, 4), epochs=3, lr=0.05, dropout=0.2, seed=3)
    models, both, _ = M._train(df, "x", "label", (8, 4), 3, 0.05, 1e-4, 0.2, [3], "row_id", None, None, False, "val")
    assert np.allclose(plain.flat(), models[0].flat()) and np.allclose([h[1] for h in hist], [h[2] for h in both])


def test_ensemble_does_not_depend_on_partitions(spark):
    a, b = (M.train_ensemble(_toy(spark, partitions=n), "x", k=3, hidden=(6, 4), epochs=3, lr=0.05)[0] for n in (1, 6))
    assert all(np.allclose(x.flat(), y.flat()) for x, y in zip(a, b))
    assert not np.allclose(a[0].flat(), a[1].flat())
    p = [1 / (1 + np.exp(-M.forward(w, np.array([[0.1, 0.2, 0.3, 0.4, 0.5, 0.6]]))[0])) for w in a]
    row = spark.createDataFrame([(1, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6])], "row_id long, x array<double>")
    got = M.ensemble_score(row, a, "x").first()
    assert got.mean_p == pytest.approx(np.mean(p)) and got.var_p == pytest.approx(np.var(p))


def test_bootstrap_weights_are_poisson():
    w = M.bootstrap_weights(np.arange(200_000), 1, 2)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(w, M.bootstrap_weights(np.arange(200_000), 1, 3))[0, 1]) < 0.01


def test_ensemble_strategy(spark):
    r = LP.run_al(spark, _toy(spark), "ensemble", batch=50, rounds=1, model="ensemble", cfg=SMALL).collect()
    assert sorted(x.n_labeled for x in r) == [100, 150]
    with pytest.raises(ValueError):
        LP.run_al(spark, _toy(spark), "ensemble", batch=50, rounds=1, model="mlp", cfg=SMALL)


def test_campaign_scores_with_the_checkpoint_of_the_best_epoch(spark):
    r = LP.run_campaign(spark, _toy(spark), "mc_dropout", 20, 100, 2, model="mlp", cfg=SMALL).collect()
    assert len(r) == 2 and all(1 <= x.best_epoch <= SMALL.epochs for x in r)


def test_frozen_batchnorm_equals_the_whole_batch_and_no_other(spark):
    df = _toy(spark, partitions=5)
    rows = df.collect()
    X, ids = np.array([r.x for r in rows]), [r.row_id for r in rows]
    w = M.init_mlp([X.shape[1], 5, 4, 1], 2)
    norms = {0: M.BatchNorm(np.linspace(0.5, 2, 5), np.linspace(-1, 1, 5)), 1: M.BatchNorm(np.ones(4), np.zeros(4), 1e-3)}
    h = X
    for i, (W, b) in enumerate(w.layers[:2]):
        z = h @ W + b
        h = np.maximum((z - z.mean(axis=0)) / np.sqrt(z.var(axis=0) + norms[i].eps) * norms[i].gamma + norms[i].beta, 0)
    want = dict(zip(ids, (h @ w.layers[2][0] + w.layers[2][1])[:, 0]))
    folded = M.freeze_batchnorm(df, w, norms, "x")
    assert folded.shapes() == w.shapes()
    got = {r.row_id: r.logit for r in M.mlp_score(df, folded, "x").collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in ids)
    few = {r.row_id: r.logit for r in M.mlp_score(df.where("row_id < 3"), folded, "x").collect()}   # fewer rows, same scores
    assert few and all(abs(few[i] - got[i]) < 1e-9 for i in few)
    other = M.freeze_batchnorm(df.repartition(11), w, norms, "x")
    assert np.allclose(other.flat(), folded.flat(), atol=1e-9)


def test_batch_moments_of_shifted_constant_and_no_rows(spark):
    w = M.MlpWeights([(np.eye(2), np.array([1e9, 0.0])), (np.ones((2, 1)), np.zeros(1))])
    df = spark.createDataFrame([([float(i % 2), 7.0],) for i in range(40)], "x array<double>")
    mean, var = M.batch_moments(df, w, "x", 0)
    assert np.allclose(mean, [1e9 + 0.5, 7]) and np.allclose(var, [0.25, 0])   # a naive sum of squares loses the 0.25
    mean, var = M.batch_moments(df.limit(0), w, "x", 0)
    assert (mean == 0).all() and (var == 1).all()
    flat = M.freeze_batchnorm(df, w, {0: M.BatchNorm(np.ones(2), np.array([0.0, 3.0]))}, "x")
    assert np.allclose((np.array([[0.0, 7.0]]) @ flat.layers[0][0] + flat.layers[0][1])[0, 1], 3.0)
    with pytest.raises(ValueError):
        M.freeze_batchnorm(df, w, {1: M.BatchNorm(np.ones(1), np.zeros(1))}, "x")


def test_blocks_reuse_their_arrays_and_masks_keep_their_draws():
    rng = np.random.default_rng(5)
    w, x, y, ids = M.init_mlp([7, 300, 5, 1], 2), rng.normal(size=(2 * M.BLOCK, 7)), rng.integers(0, 2, 2 * M.BLOCK) * 1.0, rng.integers(-9, 1 << 40, 2 * M.BLOCK)
    args = (np.ones(len(x)), 1.5, 0.3, 4, 2)
    whole, loss = M._gradient(w, x, y, ids, *args)
    room, total, losses = {}, 0.0, 0.0
    for part in M._blocks(len(x)):
        g, one = M._gradient(w, x[part], y[part], ids[part], args[0][part], *args[1:], room)
        held, total, losses = dict(room), total + g, losses + one
    assert np.allclose(total, whole) and losses == pytest.approx(loss)
    M._gradient(w, x[:9], y[:9], ids[:9], args[0][:9], *args[1:], room)
    assert all(room[k] is held[k] for k in held) and set(held) == set(room)
    with np.errstate(over="ignore"):
        key = np.uint64(4 * 1_000_003 + 2 * 7_919)
        h = M._mix(M._mix((ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ key) + np.arange(300, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    plain = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53) >= 0.3
    assert (M.keep_mask(ids, 300, 4, 2, 0, 0.3) == plain).all()
