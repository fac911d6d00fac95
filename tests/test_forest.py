"""Forests against a plain recursive one, grown in one task or level by level, on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.operators import forest as FR
from pairlab.operators import models as M
from pairlab.sources import readers as RD
from pairlab.sources import writers as WR


def rows_of(n=600, d=7, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    y = ((x[:, 0] + 0.5 * x[:, 1] > 0.3) ^ (rng.random(n) < 0.15)).astype(int)
    return x, y


def frame(spark, x, y, parts=3):
    return spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(y, x, strict=True))], "row_id long, label int, x array<double>").repartition(parts)


def plain(plan, tree, path, bins, y, draws):
    """{path: (feature, bin) or share of class 1}, one node at a time."""
    total = np.array([draws[y == k].sum() for k in (0, 1)]) * plan.weights
    best = (1e-9, None)
    if path.bit_length() <= plan.max_depth:
        for f in FR.tried(plan, tree, np.array([path]))[0]:
            for b in range(FR.BINS):
                to = bins[:, f] <= b
                if min(draws[to].sum(), draws[~to].sum()) < plan.min_leaf:
                    continue
                sides = [np.array([draws[s & (y == k)].sum() for k in (0, 1)]) * plan.weights for s in (to, ~to)]
                gain = sum((s ** 2).sum() / s.sum() for s in sides) - (total ** 2).sum() / total.sum()
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (int(f), b))
    if best[1] is None:
        return {path: float(total[1] / total.sum())}
    f, b = best[1]
    to = bins[:, f] <= b
    return {path: best[1]} | plain(plan, tree, 2 * path, bins[to], y[to], draws[to]) | plain(plan, tree, 2 * path + 1, bins[~to], y[~to], draws[~to])


def nodes(model, tree):
    out = {}

    def down(i, path):
        if model.feature[i] < 0:
            out[path] = float(model.p[model.left[i]])
        else:
            out[path] = int(model.feature[i]), int(model.bin[i])
            down(model.left[i], 2 * path)
            down(model.left[i] + 1, 2 * path + 1)

    down(model.roots[tree], 1)
    return out


@pytest.mark.parametrize("cells", [1 << 21, 3 * 90])
def test_trees_are_those_of_the_plain_way(spark, monkeypatch, cells):
    """Also where the upper levels are summed over tasks."""
    monkeypatch.setattr(FR, "CELLS", cells)
    x, y = rows_of()
    model = M.train_forest(frame(spark, x, y), "x", num_trees=3, min_leaf=2, max_depth=9, seed=5)
    n = np.bincount(y)
    plan = FR._Plan(model.edges, len(y) / (2 * n), 3, 3, 2, 9, 5)
    bins = FR.to_bins(model.edges, x)
    for t in range(3):
        draws = M.bootstrap_weights(np.arange(len(y)), 5, t)
        want, got = plain(plan, t, 1, bins[draws > 0], y[draws > 0], draws[draws > 0]), nodes(model, t)
        assert want.keys() == got.keys() and len(got) > 20
        assert all(got[k] == want[k] if isinstance(want[k], tuple) else got[k] == pytest.approx(want[k]) for k in want)


def test_where_a_node_is_grown_changes_nothing(spark, monkeypatch, tmp_path):
    x, y = rows_of(seed=4)
    df = frame(spark, x, y)
    rows = {}
    for cells, parts in ((1 << 21, 1), (3 * 40, 5)):
        monkeypatch.setattr(FR, "CELLS", cells)
        model = M.train_forest(frame(spark, x, y, parts), "x", num_trees=8)
        WR.save_forest(model, f"{tmp_path}/{parts}", trees=8)
        again, _ = RD.load_forest(spark, f"{tmp_path}/{parts}")
        for m in (model, again):
            rows[cells, m is model] = {r.row_id: r.p for r in M.forest_predict(m, df, "x").collect()}
    assert len({tuple(sorted(r.items())) for r in rows.values()}) == 1
    leaves = M.forest_predict(model, df, "x", leaves=True, keep_x=True)
    assert leaves.columns == ["row_id", "label", "x", "p", "leaves"]
    long = M.forest_leaves_long(leaves).groupBy("tree").agg(F.min("leaf").alias("low"), F.max("leaf").alias("high")).collect()
    assert len(long) == 8 and all(r.low >= 0 and r.high > 20 for r in long)


def test_odd_rows(spark):
    x, y = rows_of(60)
    one = M.train_forest(frame(spark, x, np.ones(60, int)), "x", num_trees=2)
    assert {r.p for r in M.forest_predict(one, frame(spark, x, y), "x").collect()} == {1.0}
    same = M.train_forest(frame(spark, x * 0, y), "x", num_trees=2)
    assert len({r.p for r in M.forest_predict(same, frame(spark, x, y), "x").collect()}) == 1
    few = M.train_forest(frame(spark, x[:1], y[:1]), "x", num_trees=30, balanced=False)   # some trees draw no row
    assert M.forest_predict(few, frame(spark, x, y), "x").count() == 60
    assert M.forest_predict(one, frame(spark, x, y).where("row_id < 0"), "x", leaves=True).count() == 0
    x[3, 0], x[9, 2] = np.nan, np.inf
    odd = frame(spark, x, y)
    twice = odd.unionByName(odd.withColumn("row_id", F.lit(None).cast("long")))
    assert M.forest_predict(M.train_forest(twice, "x", num_trees=3), twice, "x").where("p BETWEEN 0 AND 1").count() == 120
    with pytest.raises(ValueError):
        M.train_forest(odd.where("row_id < 0"), "x", num_trees=2)
    with pytest.raises(Exception, match="null elements"):
        M.train_forest(odd.withColumn("x", F.transform("x", lambda v: F.when(v < 0, v))), "x", num_trees=2)


def test_a_forest_left_in_a_table_scores_as_one_held(spark, monkeypatch, tmp_path):
    """Blocks of rows meet groups of trees; upper splits, leaves above and trees without a draw included."""
    x, y = rows_of(seed=8)
    df = frame(spark, x, y, 4).withColumn("tag", F.concat(F.lit("t"), "row_id"))
    for rows, cells in ((df, 1 << 21), (df, 3 * 40), (df.where("row_id < 2"), 1 << 21)):
        monkeypatch.setattr(FR, "CELLS", cells)
        held = M.train_forest(rows, "x", num_trees=9, max_depth=6, seed=2)
        for name, value in (("HELD", 0), ("GROUP", 3000), ("CHUNK", 900), ("BLOCK_ROWS", 50)):
            monkeypatch.setattr(FR, name, value)
        spread = M.train_forest(rows, "x", num_trees=9, max_depth=6, seed=2)
        assert isinstance(spread, FR.SpreadForest) and isinstance(held, FR.Forest) and (cells > 999 or spread.plan.top)
        assert rows is not df or 1 < len(spread.groups) < 9 and sorted(sum(spread.groups, [])) == list(range(9))
        a, b = ({r.row_id: r for r in M.forest_predict(m, df, "x", leaves=True, keep_x=True).collect()} for m in (held, spread))
        assert a.keys() == b.keys() and len(b) == 600
        assert all(a[i][:4] == b[i][:4] and a[i].p == pytest.approx(b[i].p, abs=1e-12) for i in a)
        for t in range(9):   # the same rows meet in a leaf
            assert len({(a[i].leaves[t], b[i].leaves[t]) for i in a}) == len({a[i].leaves[t] for i in a}) == len({b[i].leaves[t] for i in b})
        assert M.forest_predict(spread, df, "x").columns == ["row_id", "label", "tag", "p"]
        assert M.forest_predict(spread, df.where("row_id < 0"), "x", leaves=True).count() == 0
        WR.save_forest(spread, f"{tmp_path}/{cells}", trees=9)
        again, _ = RD.load_forest(spark, f"{tmp_path}/{cells}")
        assert {r.row_id: r.p for r in M.forest_predict(again, df, "x").collect()} == {r.row_id: r.p for r in M.forest_predict(held, df, "x").collect()}
        monkeypatch.undo()


def test_forest_leaf_proximity_is_that_of_all_pairs(spark, monkeypatch):
    from pairlab.operators import geometry as GE
    from pairlab.plans import catalog
    x, y = rows_of(70, seed=6)
    df, caught = frame(spark, x, y), []
    pred = M.forest_predict(M.train_forest(df, "x", num_trees=300, min_leaf=2, seed=42), df, "x", leaves=True).collect()
    leaf = np.array([r.leaves for r in pred])
    pairs = (leaf[:, None, :] == leaf[None, :, :]).mean(axis=2)
    want = {r.row_id: (pairs[i].sum() - 1) / 69 for i, r in enumerate(pred)}
    real = GE.leaf_proximity
    monkeypatch.setattr(GE, "leaf_proximity", lambda leaves: caught.append(real(leaves)) or caught[-1])
    monkeypatch.setattr(catalog, "features", lambda spark, sf_dir: df)
    got = catalog.QUERIES["forest_leaf_proximity"](spark, "").collect()
    assert len(got) == 70 and all(r.n_leaves == r.n_trees == 300 and r.leaf_ok and r.proximity_ok for r in got)
    assert {r.row_id: r.mean_proximity for r in caught[0].collect()} == pytest.approx(want) and max(want.values()) > 0
