"""The neighbour graph against all pairs in numpy: ties, copies, empty cells, full cells, plans."""

import numpy as np
import pytest

from pairlab.operators import neighbours as N


def plain(ids, x, k):
    norm = np.linalg.norm(x, axis=1)
    ok = norm > 0
    ids, u = np.asarray(ids)[ok], x[ok] / norm[ok][:, None]
    s = np.round(u @ u.T, 12)
    out = {}
    for i in range(len(ids)):
        order = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i)[:k]
        out[int(ids[i])] = [(int(n), -v) for v, n in order]
    return out


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id long, v array<double>")


def lists(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["neighbour"], r["cosine"]))
        assert r["rank"] == len(out[r["id"]])
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (60, 8)) for c in (np.eye(8) * 4)[:5]])
    x[7] = x[3] = x[200] = x[9]                      # copies
    x[50] = 0                                        # no direction
    return x


def same(got, want):
    assert set(got) == set(want)
    for i in want:
        assert [n for n, _ in got[i]] == [n for n, _ in want[i]], i
        assert np.allclose([c for _, c in got[i]], [c for _, c in want[i]])


def test_one_cell_is_exact(spark, points):
    df = frame(spark, points)
    want = plain(range(len(points)), points, 6)
    same(lists(N.knn_exact(df, df, "v", 6)), want)
    same(lists(N.knn_graph(df, "v", 6)), want)


def test_query_blocks_change_nothing(spark, points, monkeypatch):
    monkeypatch.setattr(N, "QUERY_BLOCK", 17)
    df = frame(spark, points)
    want = {i: n for i, n in plain(range(len(points)), points, 4).items() if i % 5 == 0}
    same(lists(N.knn_exact(df.where("row_id % 5 = 0"), df, "v", 4)), want)


def test_all_cells_probed_is_exact_and_full_cells_are_split(spark, points, monkeypatch):
    monkeypatch.setattr(N, "CELL", 30)
    df = frame(spark, points)
    same(lists(N.knn_graph(df, "v", 6, probes=100)), plain(range(len(points)), points, 6))


def test_recall_reaches_its_target_with_few_probes(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 50)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 1.0, (100, 16)) for c in rng.normal(0, 3, (20, 16))])
    df = frame(spark, x)
    r = N.recall(N.knn_graph(df, "v", 10).where("id % 20 = 0"), N.knn_exact(df.where("row_id % 20 = 0"), df, "v", 10)).first()
    assert r["true_neighbours"] == 1000 and r["recall"] >= 0.9


def test_copies_of_one_vector(spark):
    x = np.tile([[1.0, 2.0]], (500, 1))
    x[499] = [2.0, -1.0]
    got = lists(N.knn_graph(frame(spark, x), "v", 5))
    assert [n for n, _ in got[3]] == [0, 1, 2, 4, 5] and [n for n, _ in got[400]] == [0, 1, 2, 3, 4]
    assert [n for n, _ in got[499]] == [0, 1, 2, 3, 4] and len(got) == 500


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0])], "row_id long, v array<double>")
    assert lists(N.knn_graph(df, "v", 3)) == {} and lists(N.knn_exact(df, df, "v", 3)) == {}
    assert lists(N.knn_graph(df.where("row_id > 9"), "v", 3)) == {} and lists(N.knn_exact(df.where("row_id > 9"), df, "v", 3)) == {}


def test_plan_has_no_cross_join(spark, points):
    df = frame(spark, points)
    for t in (N.knn_graph(df, "v", 3), N.knn_exact(df, df, "v", 3)):
        plan = t._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in N.knn_exact(df, df, "v", 3)._jdf.queryExecution().executedPlan().toString()


def test_exact_search_holds_few_cosines_at_once(monkeypatch):
    import pyarrow as pa
    rng, sizes, real = np.random.default_rng(5), [], N._top
    q, x = rng.normal(size=(2_000, 4)), rng.normal(size=(3_000, 4))
    monkeypatch.setattr(N, "_top", lambda scores, ids, k: (sizes.append(scores.size), real(scores, ids, k))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3_000)), pa.array(list(x))], names=["id", "unit"])
    got = pa.Table.from_batches(list(N._search(np.arange(2_000), q, iter([batch]), 3)))
    assert max(sizes) <= N.SCORES < 2_000 * 3_000
    s = np.round(q @ x.T, N.DIGITS)
    s[np.arange(2_000), np.arange(2_000)] = -np.inf
    assert np.array_equal(got["neighbour"].to_numpy().reshape(2_000, 3), np.argsort(-s, axis=1, kind="stable")[:, :3])
