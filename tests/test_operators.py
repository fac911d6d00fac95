"""Hand-computed cases, edge cases, brute-force cross-checks and partition invariance."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.config import EngineConfig
from pairlab.functions import scores as S
from pairlab.functions import vectors as V
from pairlab.operators import acquire as A
from pairlab.operators import geometry as GE
from pairlab.operators import lookup as LK
from pairlab.operators import metrics as MT
from pairlab.operators import models as M
from pairlab.operators import sampling as SM
from pairlab.operators import tokens as TK


def test_cosine_and_antibody(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0], [0.0, 1.0])],
                               "h array<double>, l array<double>, ag array<double>")
    r = df.select(V.antibody("h", "l").alias("ab"), V.has_nonzero("l").alias("hl")) \
          .select("ab", "hl", V.cosine("ab", F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()
    assert r[0]["hl"] is False and r[0]["ab"] == [1.0, 0.0]
    assert r[1]["hl"] is True and r[1]["ab"] == [0.5, 1.0]
    assert r[0]["c"] == pytest.approx(1.0 / (1.0 + 1e-10) ** 2)
    assert r[1]["c"] == pytest.approx(0.5 / ((math.sqrt(1.25) + 1e-10) * (1 + 1e-10)))


def test_entropy_and_bce(spark):
    df = spark.createDataFrame([(0.5, 0.0, 1), (1.0, 3.0, 0)], "p double, z double, y int")
    r = df.select(S.binary_entropy("p").alias("e"), S.bce_with_logits("z", "y", 2.0).alias("l")).collect()
    assert r[0]["e"] == pytest.approx(math.log(2), rel=1e-9)
    assert r[0]["l"] == pytest.approx(2.0 * math.log(2))
    assert r[1]["l"] == pytest.approx(math.log1p(math.exp(3.0)))


def _pairs(spark):
    return spark.createDataFrame(
        [(1, "a", None, "g", 1), (2, "a", "", "g", 0), (3, "a", "b", "g", 1), (4, "a", "zz", "g", 0),
         (5, "x", "b", "g", 1), (6, "a", "b", "none", 0)],
        "row_id long, heavy_seq string, light_seq string, antigen_seq string, label int")


def _emb(spark):
    return spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("g", [1.0, 1.0])],
                                 "seq string, embedding array<double>")


def test_lookup_strict_light_policy(spark):
    r = {x["row_id"]: x for x in LK.lookup_strict(_pairs(spark), _emb(spark)).collect()}
    assert sorted(r) == [1, 2, 3, 4]          # 5: heavy miss, 6: antigen miss
    assert r[1]["light_status"] == "empty" and r[2]["light_status"] == "empty"
    assert r[3]["light_status"] == "hit" and r[3]["light_emb"] == [0.0, 1.0]
    assert r[4]["light_status"] == "missing" and r[4]["light_emb"] is None


def test_lookup_lenient_keeps_any_hit(spark):
    r = {x["row_id"]: x for x in LK.lookup_lenient(_pairs(spark), _emb(spark), 2).collect()}
    assert sorted(r) == [1, 2, 3, 4, 5, 6]
    assert r[5]["h"] == [0.0, 0.0] and r[5]["light_hit"]
    assert r[6]["ag"] == [0.0, 0.0] and not r[6]["antigen_hit"]


def test_lookup_strategy_does_not_change_the_result(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 50}") for i in range(3000)]
    left = spark.createDataFrame(rows, "row_id long, key string")
    right = spark.createDataFrame([("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(50)], "k string, v double")
    from pairlab.operators.joins import lookup_join
    a = sorted(map(tuple, lookup_join(left, right, "key", "k", "left").collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = lookup_join(left, right, "key", "k", "left")
        assert "SortMergeJoin" in b._jdf.queryExecution().executedPlan().toString()
        assert a == sorted(map(tuple, b.collect())) and len(a) == 3000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rows_without_a_light_chain_and_hot_antigens_are_spread(spark):
    """Shuffled lookups: no task gets most of the rows, and a hot antigen's partition is one that adaptive skew handling may split."""
    from pairlab.operators.joins import lookup_join
    pairs = spark.range(20_000).select(F.col("id").alias("row_id"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("heavy_seq"), F.lit(None).cast("string").alias("light_seq"))
    emb = _emb(spark)
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        side = LK._side(LK.one_per_key(emb, "seq", "embedding"), "light", "seq", "embedding")
        got = lookup_join(pairs, side, "light_seq", "_light_k", "left")
        most = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most < 10_000 and got.where("light_emb IS NULL").count() == 20_000
        side = LK._side(LK.one_per_key(emb, "seq", "embedding"), "heavy", "seq", "embedding")
        plan = lookup_join(pairs, side, "heavy_seq", "_heavy_k", "inner")._jdf.queryExecution().executedPlan().toString().splitlines()
        sorts = [i for i, line in enumerate(plan) if "Sort [" in line and "_name" in line]
        assert len(sorts) == 2 and all("Exchange" in plan[i + 1] for i in sorts)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lookup_widens_stored_floats_behind_the_joins(spark):
    emb = _emb(spark).withColumn("embedding", F.col("embedding").cast("array<float>"))
    strict = LK.lookup_strict(_pairs(spark), emb)
    assert dict(strict.dtypes)["heavy_emb"] == "array<double>" and sorted(map(str, strict.collect())) == sorted(map(str, LK.lookup_strict(_pairs(spark), _emb(spark)).collect()))
    lenient = LK.lookup_lenient(_pairs(spark), emb, 2)
    assert dict(lenient.dtypes)["h"] == "array<double>" and sorted(map(str, lenient.collect())) == sorted(map(str, LK.lookup_lenient(_pairs(spark), _emb(spark), 2).collect()))


def test_duplicate_sequences_do_not_fan_out(spark):
    emb = spark.createDataFrame([("H", [1.0, 0.0], "f1", 0), ("H", [2.0, 0.0], "f1", 7), ("H", [9.0, 9.0], "f0", 9), ("G", [0.0, 1.0], "f1", 1)],
                                "seq string, embedding array<double>, _file string, _pos long")
    pairs = spark.createDataFrame([(1, "H", None, "G", 1)], "row_id long, heavy_seq string, light_seq string, antigen_seq string, label int")
    for got in (LK.lookup_strict(pairs, emb).collect(), LK.lookup_lenient(pairs, emb, 2).collect()):
        assert len(got) == 1 and (got[0].heavy_emb if "heavy_emb" in got[0] else got[0].h) == [2.0, 0.0]


def test_lookup_reads_the_pairs_once_and_runs_nothing_early(spark, tmp_path):
    _pairs(spark).write.parquet(f"{tmp_path}/p")
    _emb(spark).write.parquet(f"{tmp_path}/e")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    group = "lookup-plan"
    spark.sparkContext.setJobGroup(group, group)
    try:
        pairs, emb = spark.read.schema(_pairs(spark).schema).parquet(f"{tmp_path}/p"), spark.read.schema(_emb(spark).schema).parquet(f"{tmp_path}/e")
        plan = LK.lookup_strict(pairs, emb)._jdf.queryExecution().executedPlan().toString()
        assert plan.count(f"{tmp_path}/p") == 1 and "Union" not in plan
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def _toy(spark, n=400, d=6, partitions=3):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, d))
    rows = [(i, f"h{i // 2}", None, f"g{i % 7}", int(x[i, 0] + 0.3 * x[i, 1] > 0), x[i].tolist(), float(abs(x[i, 2]))) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, heavy_seq string, light_seq string, antigen_seq string, label int, x array<double>, salience double").repartition(partitions)


def test_forest_and_kmeans_do_not_depend_on_partitions(spark):
    a, b = ({r.row_id: r.p for r in M.forest_predict(M.train_forest(_toy(spark, partitions=n), "x", num_trees=5), _toy(spark), "x").collect()} for n in (1, 7))
    assert a == b
    a, b = (sorted(tuple(c) for c in M.kmeans_best(_toy(spark, 80, partitions=n), "x", 5).clusterCenters()) for n in (1, 7))
    assert np.allclose(a, b)


def test_loop_ends_when_the_pool_is_empty(spark):
    from pairlab.plans import loop as LP
    r = sorted(LP.run_al(spark, _toy(spark), "uncertainty", batch=90, forest_trees=5).collect(), key=lambda x: x["round"])
    assert [x.n_labeled for x in r] == [100, 190, 280, 320] and [x.pool_left for x in r] == [220, 130, 40, 0]
    short = LP.run_al(spark, _toy(spark), "random", batch=90, forest_trees=5, rounds=1).collect()
    assert len(short) == 2 and max(x.n_labeled for x in short) == 190


def test_campaign_takes_whole_triples_and_needs_the_mlp_for_dropout(spark, tmp_path):
    from pairlab.plans import loop as LP
    data = _toy(spark).withColumn("antigen_seq", F.lit("g"))  # two rows share each (heavy, light, antigen)
    r = LP.run_campaign(spark, data, "passive", 20, 100, 2, forest_trees=5, report_uri=f"{tmp_path}/out").collect()
    assert [x.n_labeled for x in r] == [120, 140] and sum(x.is_best for x in r) == 1
    # rows left are less than 320 - labelled: the twins of picked rows are gone too
    assert all(x.pool_left < 320 - x.n_labeled for x in r)
    assert spark.read.json(f"{tmp_path}/out/report").count() == 2
    with pytest.raises(ValueError):
        LP.run_campaign(spark, data, "mc_dropout", model="forest")
    with pytest.raises(ValueError):
        LP.Learner("tree", data, "x", EngineConfig(), 0, 0)


def test_null_scores_are_not_ranked(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)]
    a = spark.createDataFrame(rows, "y int, p double")
    b = spark.createDataFrame([*rows, (1, None), (0, None), (None, 0.5)], "y int, p double")
    assert MT.auroc(a).first() == MT.auroc(b).first() and MT.average_precision(a).first() == MT.average_precision(b).first()


def test_anti_join_removes_every_duplicate(spark):
    pool = spark.createDataFrame([(1, "a", None, "g"), (2, "a", "", "g"), (3, "a", "b", "g")],
                                 "row_id long, heavy_seq string, light_seq string, antigen_seq string")
    left = LK.pool_minus_selected(pool, pool.where("row_id = 1"))
    assert [r.row_id for r in left.collect()] == [3]   # NULL and '' light are the same key


def test_quota_select_exact_and_partition_invariant(spark):
    rows = [(i, i % 3) for i in range(2000)]
    random.Random(1).shuffle(rows)
    base = spark.createDataFrame(rows, "row_id long, label int")
    outs = []
    for parts in (1, 3, 8):
        s = SM.stratified_split(base.repartition(parts), "label", 0.2, seed=5)
        got = s.groupBy("label").agg(F.count_if("is_test").alias("t"), F.count(F.lit(1)).alias("n")).collect()
        for g in got:
            assert g["t"] == round(0.2 * g["n"])
        outs.append(sorted(r.row_id for r in s.where("is_test").collect()))
    assert outs[0] == outs[1] == outs[2]


def test_balanced_seed_fails_on_small_class(spark):
    df = spark.createDataFrame([(i, 1 if i < 3 else 0) for i in range(100)], "row_id long, label int")
    with pytest.raises(Exception):
        SM.balanced_seed(df, 10, seed=0).collect()


def _brute_ap_auc(y, p):
    y, p = np.asarray(y), np.asarray(p)
    P, N = y.sum(), len(y) - y.sum()
    ap = 0.0
    for s in sorted(set(p), reverse=True):
        sel = p >= s
        ap += ((y == 1) & (p == s)).sum() / P * (y[sel].sum() / sel.sum())
    auc = sum(((p[y == 1][:, None] > p[y == 0][None, :]) + 0.5 * (p[y == 1][:, None] == p[y == 0][None, :])).ravel())
    return ap, auc / (P * N)


def test_ranking_metrics_against_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 700)
    p = np.round(rng.random(700), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double").repartition(5)
    ap, auc = _brute_ap_auc(y, p)
    r = MT.evaluate_scores(df).first()
    assert r["auprc"] == pytest.approx(ap, abs=1e-12)
    assert r["auroc"] == pytest.approx(auc, abs=1e-12)


def test_auroc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.7)], "y int, p double")
    assert MT.auroc(df).first()["auroc"] is None


def test_top_k_short_batch_and_ties(spark):
    df = spark.createDataFrame([(i, 0.5) for i in range(5)], "row_id long, s double")
    assert [r.row_id for r in A.top_by_score(df, "s", 3).collect()] == [0, 1, 2]
    assert A.top_by_score(df, "s", 96).count() == 5


def test_leaf_proximity_matches_pairs(spark):
    rng = np.random.default_rng(0)
    leaves = rng.integers(0, 4, (40, 3))
    df = spark.createDataFrame([(i, t, int(leaves[i, t])) for i in range(40) for t in range(3)],
                               "row_id long, tree int, leaf long")
    got = {r.row_id: r.shared_leaves for r in GE.leaf_proximity(df).collect()}
    for i in range(40):
        assert got[i] == int(sum((leaves[j] == leaves[i]).sum() for j in range(40) if j != i))


def test_decode_tokens_rejects_bad_length(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "data array<double>")
    with pytest.raises(Exception):
        TK.decode_tokens(df.withColumn("shape", F.lit(None).cast("array<bigint>")), dim=2).collect()


def test_mc_scores_do_not_depend_on_partitioning(spark):
    w = M.init_mlp([4, 8, 1], seed=1)
    rows = [(i, [float(np.sin(i + k)) for k in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>")
    a = {r.row_id: r.mean_p for r in M.mc_dropout_score(df.repartition(1), w, "x", 5, 0.3).collect()}
    b = {r.row_id: r.mean_p for r in M.mc_dropout_score(df.repartition(7), w, "x", 5, 0.3).collect()}
    assert a == b


def test_gradient_job_matches_finite_differences(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist(), int(rng.integers(0, 2))) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, x array<double>, label int").repartition(3)
    w = M.init_mlp([3, 4, 1], seed=0)
    (g, sums), = M._pass(df, [w], "x", "label", "row_id", 1.5, 0.0, [0], 1, False, None)
    loss, n = sums["loss"], sums["n"]
    X = np.array([r[1] for r in rows])
    Y = np.array([r[2] for r in rows], dtype=float)

    def total(theta):
        z = M.forward(M.MlpWeights.unflat(theta, w.shapes()), X)
        return float((1.5 * Y * np.logaddexp(0, -z) + (1 - Y) * np.logaddexp(0, z)).sum())

    th = w.flat()
    assert n == 60 and loss == pytest.approx(total(th))
    for i in range(0, th.size, 3):
        e = np.zeros_like(th)
        e[i] = 1e-6
        assert g[i] == pytest.approx((total(th + e) - total(th - e)) / 2e-6, rel=1e-4, abs=1e-6)


def test_registries_reject_unknown_names(spark):
    from pairlab.operators.encode import get_encoder
    from pairlab.plans.loop import acquire
    with pytest.raises(ValueError):
        get_encoder("no-such-model")
    df = spark.createDataFrame([(1, [0.0], 1.0)], "row_id long, x array<double>, salience double")
    with pytest.raises(ValueError):
        acquire("nope", df, None, 1, 0, 0, EngineConfig())


def test_csv_keeps_empty_and_null_light(spark, tmp_path):
    from pairlab.sources.readers import read_pairs_csv
    p = tmp_path / "pairs.csv"
    p.write_text('row_id,heavy_seq,light_seq,antigen_seq,antigen_name,label\n1,a,,g,,1\n2,a,"",g,x,0\n')
    r = {x.row_id: x for x in read_pairs_csv(spark, str(p)).collect()}
    assert r[1]["light_seq"] is None and r[2]["light_seq"] == ""


def test_read_sequences_empty_input_raises(spark, tmp_path):
    from pairlab.sources.readers import read_sequences
    d = tmp_path / "seqs"
    d.mkdir()
    (d / "a.txt").write_text("\n   \n")
    with pytest.raises(ValueError):
        read_sequences(spark, str(d))


def test_flagship_plan_shape(spark):
    import __spark_entry__ as E
    plan = E.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "BroadcastHashJoin" in plan


def test_split_windows_are_partitioned(spark):
    """Every window in the exact split is partitioned (class, hash bucket): no single-task window."""
    import re
    df = spark.createDataFrame([(i, i % 2) for i in range(500)], "row_id long, label int")
    plan = SM.stratified_split(df, "label", 0.2, seed=1)._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[.*", plan)
    assert windows
    for w in windows:
        assert "label" in w.split("],")[-2] or "_bk" in w


def test_queries_train_at_the_studies_sizes(monkeypatch):
    """Trees of campaign and grid and epochs of the dropout scores are those of the studies."""
    from pairlab.config import EngineConfig
    from pairlab.plans import catalog

    class Called(Exception):
        pass

    def caught(owner, name, query):
        def stop(*args, **kw):
            raise Called(kw)

        monkeypatch.setattr(owner, name, stop)
        monkeypatch.setattr(catalog, "features", lambda spark, sf_dir: None)
        try:
            catalog.QUERIES[query](None, "")
        except Called as e:
            return e.args[0]

    assert EngineConfig().forest_trees == 200 and EngineConfig().epochs == 30
    assert caught(catalog.LP, "run_campaign", "al_campaign").get("forest_trees") in (None, 200)
    assert caught(catalog.LP, "experiment_grid", "experiment_grid").get("forest_trees") in (None, 200)
    assert caught(catalog.M, "train_mlp", "mc_dropout_score")["epochs"] == 30


def test_division_by_cuts_is_the_join_with_the_test_ids_and_shuffles_no_wide_row(spark):
    rows = [(None if i == 7 else i % 190, i % 2 if i < 190 else 1 - i % 2 if i < 195 else i % 2, [float(i)] * 4) for i in range(300)]
    for table in (rows[:190], rows[:190] * 2, rows):  # unique ids, repeated rows, ids with two labels
        data = spark.createDataFrame(table, "row_id long, label int, x array<double>")
        for split, by, first in ((SM.stratified_split(data.select("row_id", "label"), "label", 0.2, 3), ["label"], True),
                                 (SM.shuffle_split(data.select("row_id"), 0.2, 3), [], False)):
            split = spark.createDataFrame(split.collect(), split.schema)
            rest, test = SM.divide(data, split, 3, by, first)
            held = split.where("is_test").select("row_id")
            assert sorted(map(str, rest.collect())) == sorted(map(str, data.join(held, "row_id", "left_anti").collect()))
            assert sorted(map(str, test.collect())) == sorted(map(str, data.join(held, "row_id", "left_semi").collect()))
            if table is not rows:
                assert "hashpartitioning" not in rest._jdf.queryExecution().executedPlan().toString()


def test_loop_writes_its_training_rows_and_scans_the_pool_once_a_fit(spark, tmp_path, monkeypatch):
    from pairlab.plans import loop as LP
    seen = []
    real = M.train_mlp

    def fit(train, *a, **k):
        seen.append(train.inputFiles())
        return real(train, *a, **k)

    monkeypatch.setattr(M, "train_mlp", fit)
    LP.run_al(spark, _toy(spark), "uncertainty", batch=20, rounds=1, model="mlp", cfg=EngineConfig(hidden=8, epochs=2, mc_passes=2))
    assert len(seen) == 2 and all(files and all("/train/" in f for f in files) for files in seen)


def test_scaling_runs_its_fit_once(spark):
    from pairlab.operators import scaling as SC
    data = _toy(spark)
    out = SC.standard_scale_apply(data, SC.standard_scale_fit(data, "x"), "x")
    assert out._jdf.queryExecution().analyzed().toString().count("scalar-subquery") == 1
    x = np.array([r.x for r in data.collect()])
    got = np.array([r.x_scaled for r in out.collect()])
    assert np.allclose(np.sort(got, axis=0), np.sort((x - x.mean(0)) / x.std(0), axis=0))


def test_frozen_rows_are_looked_up_once(spark):
    from conftest import SF_SMALL
    from pairlab.plans import catalog
    rows, _ = catalog._frozen(spark, SF_SMALL)
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()


def test_uncertain_rows_are_chosen_before_wide_rows_are_joined(spark):
    from pairlab.plans import catalog
    rng = np.random.default_rng(8)
    rows = [(None if i == 5 else i // 2, [1.0, float(c)]) for i, c in enumerate(rng.uniform(-1, 1, 300))]
    data = spark.createDataFrame(rows, "row_id long, x array<double>")
    c = data.select("row_id", S.binary_entropy((F.lit(1.0) + F.element_at("x", -1)) / 2.0).alias("entropy"))
    want = A.top_by_score(data.join(c, "row_id"), "entropy", 40).select("entropy").collect()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = catalog._scored(data, 40)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert A.top_by_score(got, "entropy", 40).select("entropy").collect() == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_quotas_shuffle_no_row_beyond_the_divided_bucket(spark):
    """Against the plain way, with null and repeated ids and groups; the rows themselves meet the cuts in a broadcast."""
    rows = [(None if i % 50 == 7 else i % 900, None if i % 97 == 0 else i % 3) for i in range(1200)]
    df = spark.createDataFrame(rows, "row_id long, label int").repartition(5)
    for by, quota in ((["label"], lambda n: F.round(n * 0.3)), ([], lambda n: F.floor(n * 0.8)), (["label"], lambda n: n), (["label"], lambda n: F.lit(0))):
        d = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit("5"), F.col("row_id").cast("string"))))
        got = SM.quota_select(d, "_h", quota, by)
        want = {}
        for r in d.collect():
            want.setdefault(r.label if by else 0, []).append((r._h, -1 if r.row_id is None else r.row_id))
        n = {k: int(spark.range(1).select(quota(F.lit(len(v)))).first()[0]) for k, v in want.items() if k is not None}
        want = sorted(x for k, v in want.items() if k is not None for x in sorted(v)[:n[k]])
        assert sorted((r._h, -1 if r.row_id is None else r.row_id) for r in got.where("selected").collect()) == want
        assert got.count() == (df.where("label IS NOT NULL").count() if by else 1200)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "Broadcast" in plan


def test_marked_rows_are_those_of_the_join_and_wide_rows_are_not_shuffled(spark):
    rows = [(None if i == 7 else i, i % 2, [float(i)] * 4) for i in range(190)]
    for table in (rows, rows + rows[:60]):  # unique ids, repeated ones
        data = spark.createDataFrame(table, "row_id long, label int, x array<double>")
        split = SM.shuffle_split(data.select("row_id"), 0.2, 3)
        split = spark.createDataFrame(split.collect(), split.schema)
        got = SM.mark(data, split, 3, "val")
        want = data.join(split.select("row_id", F.col("is_test").alias("val")), "row_id").select(got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("val").count() >= 36
        assert table is not rows or "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_fixed_horizon_is_that_of_the_study(monkeypatch):
    from pairlab.plans import catalog, oracle
    caught = {}
    monkeypatch.setattr(catalog, "features", lambda spark, sf_dir: None)
    monkeypatch.setattr(catalog, "_progress", lambda r: r)
    monkeypatch.setattr(catalog.LP, "run_al", lambda *args, **kw: caught.update(kw))
    catalog.QUERIES["al_loop_fixed"](None, "")
    assert caught["rounds"] == 25 and caught["batch"] == 96 and "range(0, 25 + 1)" in oracle.ORACLE["al_loop_fixed"]
