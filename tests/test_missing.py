"""Encode once, the sketched plane, separability, observed counters, forests on disk, loops that go on after a stop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.operators import encode as EN
from pairlab.operators import geometry as GE
from pairlab.operators import lookup as LK
from pairlab.operators import models as M
from pairlab.plans import feature_pipeline as FP
from pairlab.plans import loop as LP
from pairlab.operators import metrics as MT
from pairlab.sources import readers as RD
from pairlab.sources import writers as WR
from tests.test_operators import _toy


def test_every_distinct_sequence_is_encoded_once(spark):
    seqs = ["ABC", "ABC", "", None, "Z" * 500, "Q" * 30] * 40 + [f"s{i}" for i in range(90)]
    df = spark.createDataFrame(list(enumerate(seqs)), "row_id long, seq string").repartition(4)
    calls = spark.sparkContext.accumulator(0)
    enc = EN.get_encoder("composition", dim=8)
    got = {r.row_id: r.embedding for r in EN.extract_once(df, "seq", enc, budget=200, calls=calls).collect()}
    want = {r.row_id: r.embedding for r in EN.extract_embeddings(df, "seq", enc).collect()}
    assert got == want and calls.value == len({s for s in seqs if s is not None})
    assert EN.extract_once(df.limit(0), "seq", enc).collect() == []


def test_packs_keep_the_budget():
    lengths = [1, 1, 2, 9, 9, 9, 40, 100]
    found = list(EN.packs(lengths, 27))
    assert [i for a, b in found for i in range(a, b)] == list(range(8))
    assert all((b - a) * max(lengths[a:b]) <= 27 or b - a == 1 for a, b in found) and list(EN.packs([], 5)) == []


def test_sketched_plane_is_the_pca_plane(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 30)) * 3 * 0.7 ** np.arange(30) + 5
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, v array<double>").repartition(4)
    rows = sorted(GE.project_sketch(df, "v").collect(), key=lambda r: r.row_id)
    got = np.array([r.xy for r in rows])
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    want = c @ vt[:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-3) and np.allclose(got.mean(0), 0, atol=1e-9)
    assert GE.project_sketch(df.limit(0), "v").collect() == []


def test_sketch_takes_widths_that_pca_refuses(spark):
    wide = GE.PCA_WIDTH + 10
    df = spark.createDataFrame([(i, [float((i * j) % 7) for j in range(wide)]) for i in range(12)], "row_id long, v array<double>")
    assert {len(r.xy) for r in GE.project_sketch(df, "v", passes=1).collect()} == {2}


def test_separability_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(90, 4)), np.arange(90) % 3
    x[y == 1] += 2
    df = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(y, x)], "label int, v array<double>")
    got = GE.separability(df, "v").first()
    mu = np.array([x[y == k].mean(0) for k in range(3)])
    within = sum(((x[y == k] - mu[k]) ** 2).sum() for k in range(3))
    between = sum((y == k).sum() * ((mu[k] - x.mean(0)) ** 2).sum() for k in range(3))
    d = np.linalg.norm(x[:, None] - mu[None], axis=2)
    a = d[np.arange(90), y]
    b = np.where(np.arange(3)[None] == y[:, None], np.inf, d).min(1)
    assert got.n == 90 and got.within == pytest.approx(within) and got.between == pytest.approx(between)
    assert got.silhouette == pytest.approx(((b - a) / np.maximum(a, b)).mean())
    assert GE.separability(df.where("label = 1"), "v").first().silhouette is None


def test_counters_are_observed_on_the_write(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "a", "b", "c", 1), (2, "a", None, "x", 0), (3, "x", "", "y", 1)], "row_id long, heavy_seq string, light_seq string, antigen_seq string, label int")
    emb = spark.createDataFrame([(s, [1.0, 2.0]) for s in "abc"], "seq string, embedding array<double>")
    got = LK.write_lookup(pairs, emb, 2, f"{tmp_path}/l").first()
    assert got.asDict() == LK.lookup_coverage(pairs, emb).first().asDict()
    assert spark.read.parquet(f"{tmp_path}/l").count() == got.kept == 2


def test_forest_comes_back_from_disk(spark, tmp_path):
    df = _toy(spark)
    model = M.train_forest(df, "x", num_trees=4)
    WR.save_forest(model, f"{tmp_path}/f", round=3)
    again, facts = RD.load_forest(spark, f"{tmp_path}/f")
    assert facts == {"round": 3}
    a, b = ({r.row_id: r.p for r in M.forest_predict(m, df, "x").collect()} for m in (model, again))
    assert a == b


def test_forest_predicts_in_a_session_that_has_observed(spark):
    from pyspark.sql import Observation
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}
    model = M.train_forest(_toy(spark), "x", num_trees=2)
    assert M.forest_predict(model, _toy(spark), "x").count() == len(M.forest_predict(model, _toy(spark), "x").collect()) == 400


def test_stopped_loop_goes_on_behind_its_last_round(spark, monkeypatch):
    data = _toy(spark)
    whole = LP.run_al(spark, data, "hybrid", batch=40, rounds=2, forest_trees=3, run="whole").collect()
    fits = []
    real = LP.Learner

    class Stops(real):
        def __init__(self, *a, **k):
            fits.append(a[5])
            if len(fits) == 2:
                raise RuntimeError("killed")
            super().__init__(*a, **k)

    monkeypatch.setattr(LP, "Learner", Stops)
    with pytest.raises(RuntimeError):
        LP.run_al(spark, data, "hybrid", batch=40, rounds=2, forest_trees=3, run="torn")
    resumed = LP.run_al(spark, data, "hybrid", batch=40, rounds=2, forest_trees=3, run="torn").collect()
    assert fits == [0, 1, 1, 2] and resumed == whole
    state = LP.LoopState(spark, "torn")
    assert state.labelled(2).count() == 180 and state.labelled(1).agg(F.max("round")).first()[0] == 1
    assert sorted(tuple(r) for r in state.labelled(2).collect()) == sorted(tuple(r) for r in LP.LoopState(spark, "whole").labelled(2).collect())


def test_gzipped_csv_is_a_csv(spark, tmp_path):
    import gzip
    with gzip.open(f"{tmp_path}/a.csv.gz", "wt") as f:
        f.write("id,sequence\n1,ABC\n2,DEF\n")
    assert sorted(r.seq for r in RD.read_sequences(spark, f"{tmp_path}/a.csv.gz").collect()) == ["ABC", "DEF"]


def test_pipeline_over_flat_and_empty_embeddings(spark, tmp_path):
    pairs = spark.createDataFrame([(1, "a", "", "b", 1), (2, "z", None, "y", 0)], "row_id long, heavy_seq string, light_seq string, antigen_seq string, label int")
    flat = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0]), ("b", [5.0, 6.0])], "text string, embedding array<float>")
    flat.write.parquet(f"{tmp_path}/flat")
    r, = FP.feature_pipeline(spark, pairs, f"{tmp_path}/flat", f"{tmp_path}/c1", dim=2).collect()
    assert (r.row_id, r.x) == (1, [2.0, 3.0, 0.0, 0.0, 5.0, 6.0])
    with pytest.raises(ValueError):
        FP.feature_pipeline(spark, pairs, f"{tmp_path}/flat", f"{tmp_path}/c2")
    flat.limit(0).write.parquet(f"{tmp_path}/none")
    none = FP.feature_pipeline(spark, pairs, f"{tmp_path}/none", f"{tmp_path}/c3")
    assert none.collect() == [] and "x" in none.columns


def test_nan_is_no_score(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1), (1, float("nan"))], "y int, p double")
    assert MT.evaluate_scores(df).first().asDict() == MT.evaluate_scores(df.where(~F.isnan("p"))).first().asDict()
    assert MT.auroc(df).first()[0] == 0.75 and MT.accuracy(df).first()[0] == MT.accuracy(df.where(~F.isnan("p"))).first()[0]
