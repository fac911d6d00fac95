"""Cosine k-nearest neighbours: exact in blocks for a stated query set, and an inverted-file index for all rows.

``knn_exact`` compares a query set with all rows: blocks of queries are broadcast one after another (each of a fixed
number of rows), every task keeps the k best of its own rows, and only those are shuffled.

``knn_graph`` finds neighbours of every row without comparing every pair:

1. Equal vectors are one node. Its ``k + 1`` least ids stand for it; copies are neighbours of each other first, so a
   vector that a third of all rows share costs one node.
2. Coarse centres come from k-means on a sample of at most ``SAMPLE`` nodes, about one centre for ``CELL`` nodes
   and at most ``MAX_CENTRES``: a model of bounded size, which the tasks get by broadcast.
3. Every node is stored in the cell of its nearest centre and looks into the cells of its ``probes`` nearest ones. How
   many are needed is measured: the true neighbours of about ``TRIAL`` nodes, and the rank of the cells they lie
   in; the least number of probes that reaches ``target`` of them is taken.
4. Cells are cut into blocks of about ``CELL`` nodes by a hash of the node, so a full cell spreads over many
   tasks: a block of seekers meets a block of stored nodes, one product of two small matrices, and gives the k best
   of each seeker.
5. The k best over all blocks: row numbers with a limit before the shuffle, so no seeker's candidates are
   gathered whole.

Ties break by the least id. A row without a vector, with a vector of length zero, or with a NaN has no cosine: it seeks
nothing and is nobody's neighbour. Work grows with n * probes * CELL; vectors without any cluster structure need a
good part of all cells. The share of true neighbours found is measured by ``recall``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlab.config import state_path

SAMPLE = 20_000
CELL = 2_000
MAX_CENTRES = 4_096
TRIAL = 256
QUERY_BLOCK = 4_096
#: Cosines that a task of ``knn_exact`` holds at once, about.
SCORES = 1 << 20
DIGITS = 12


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of one width."""
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(n, -1) if n else np.zeros((0, 0))


def unit_vectors(df: DataFrame, vec: str, id_col: str = "row_id") -> DataFrame:
    """(id, unit): vectors scaled to length one; rows that have no direction are left out."""
    v = F.col(vec).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    kept = df.select(F.col(id_col).alias("id"), v.alias("v"), norm.alias("norm")).where((F.col("norm") > 0) & ~F.isnan("norm") & (F.col("norm") < math.inf))
    return kept.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best (cosine, least id) of each seeker, numbered from 1."""
    w = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row, equal scores by the least id; -inf is no candidate."""
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        row, col = np.nonzero((scores >= floor) & (scores > -np.inf))
    else:
        row, col = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep]


def _search(ids: np.ndarray, q: np.ndarray, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, neighbour, cosine) of the k best rows of each batch for every query, about ``SCORES`` cosines at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        mine, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
        step = max(1, SCORES // len(mine))
        for lo in range(0, len(ids), step):
            who = ids[lo:lo + step]
            scores = np.round(q[lo:lo + step] @ x.T, DIGITS)
            scores[who[:, None] == mine[None, :]] = -np.inf
            row, col = _top(scores, mine, k)
            yield pa.RecordBatch.from_arrays([pa.array(who[row]), pa.array(mine[col]), pa.array(scores[row, col])], names=["id", "neighbour", "cosine"])


def knn_exact(queries: DataFrame, base: DataFrame, vec: str, k: int = 30, id_col: str = "row_id") -> DataFrame:
    """(id, rank, neighbour, cosine) of the k rows of ``base`` nearest to every row of ``queries``, itself left out.

    Queries go out in blocks of ``QUERY_BLOCK`` rows; every block scans ``base`` once. A task compares as many of them with a batch
    at once as make about ``SCORES`` cosines.
    """
    spark = base.sparkSession
    path = state_path(spark, "knn", f"queries-{np.random.default_rng().integers(1 << 62):x}")
    unit_vectors(queries, vec, id_col).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(queries.count() / QUERY_BLOCK))))).write.parquet(path)
    asked = spark.read.parquet(path)
    stored = unit_vectors(base, vec, id_col)
    out = None
    for (block,) in asked.select("block").distinct().orderBy("block").collect():
        rows = asked.where(F.col("block") == block).select("id", "unit").toArrow()
        shared = spark.sparkContext.broadcast((rows.column("id").to_numpy(), _matrix(rows.column("unit").combine_chunks())))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return _search(*shared.value, batches, k)

        part = stored.mapInArrow(search, "id long, neighbour long, cosine double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "id long, neighbour long, cosine double")
    return _best(out, k).select("id", "rank", "neighbour", "cosine")


def _centres(nodes: DataFrame, n: int) -> np.ndarray:
    """Unit centres of the cells, from a sample by a hash of the id that is laid out alike every time."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from pairlab.operators.models import canonical

    cells = max(1, min(MAX_CENTRES, math.ceil(n / CELL)))
    share = min(1.0, SAMPLE / max(n, 1))
    some = nodes.where(F.pmod(F.xxhash64(F.lit("centres"), "id"), F.lit(1_000_000)) < int(share * 1_000_000))
    if cells == 1:
        width = nodes.select(F.size("unit")).first()[0]
        return np.zeros((1, width))
    model = KMeans(k=cells, seed=7, featuresCol="_v", distanceMeasure="cosine", maxIter=10).fit(
        canonical(some.select("id", array_to_vector("unit").alias("_v")), "id"))
    return np.array(model.clusterCenters())


def _ranking(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells of each row, the nearest centre first."""
    return np.argsort(-(x @ centres.T), axis=1, kind="stable")


def _probes(placed: DataFrame, n: int, k: int, centres: np.ndarray, target: float) -> int:
    """The least number of cells that hold ``target`` of the true neighbours of a trial of about ``TRIAL`` nodes."""
    if len(centres) == 1:
        return 1
    trial = placed.where(F.pmod(F.xxhash64(F.lit("trial"), "id"), F.lit(1_000_000)) < max(1, int(TRIAL / n * 1_000_000)))
    true = knn_exact(trial, placed, "unit", k, "id").join(placed.select(F.col("id").alias("neighbour"), "cell"), "neighbour").select("id", "cell").toArrow()
    rows = trial.select("id", "unit").toArrow()
    if not true.num_rows:
        return len(centres)
    order = np.argsort(_ranking(_matrix(rows.column("unit").combine_chunks()), centres), axis=1)  # by row: rank of each cell
    at = {i: r for r, i in enumerate(rows.column("id").to_pylist())}
    ranks = np.sort(order[[at[i] for i in true.column("id").to_pylist()], true.column("cell").to_numpy()])
    return int(ranks[math.ceil(target * len(ranks)) - 1]) + 1


def knn_graph(df: DataFrame, vec: str, k: int = 30, id_col: str = "row_id", probes: int | None = None,
              target: float = 0.95) -> DataFrame:
    """(id, rank, neighbour, cosine): about the k nearest rows of every row, itself left out (see the module).

    ``probes`` fixes the number of cells that a row looks into; else it is measured for the ``target``.
    """
    spark = df.sparkSession
    root = state_path(spark, "knn", f"graph-{np.random.default_rng().integers(1 << 62):x}")

    def save(t: DataFrame, name: str) -> DataFrame:
        t.write.parquet(f"{root}/{name}")
        return spark.read.schema(t.schema).parquet(f"{root}/{name}")

    # equal vectors: one node; first within a salt, so that no task holds all copies of one vector
    rows = save(unit_vectors(df, vec, id_col).withColumn("key", F.xxhash64("unit")), "rows")
    salted = Window.partitionBy("key", "unit", "salt").orderBy("id")
    few = (rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
           .groupBy("key", "unit").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")))
    nodes = save(few.select(F.col("ids")[0].alias("id"), "ids", "key", "unit"), "nodes")
    n = nodes.count()
    if n == 0:
        return spark.createDataFrame([], "id long, rank int, neighbour long, cosine double")
    centres = spark.sparkContext.broadcast(_centres(nodes, n))

    def looker(probes: int):
        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = _ranking(_matrix(batch.column(1)), centres.value)[:, :probes]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.tolist(), pa.list_(pa.int32()))],
                                                     names=["id", "unit", "cells"])

        return lambda t: t.select("id", "unit").mapInArrow(cells, "id long, unit array<double>, cells array<int>")

    placed = save(looker(1)(nodes).select("id", "unit", F.col("cells")[0].alias("cell")), "placed")
    if probes is None:
        probes = _probes(placed, n, k, centres.value, target)
    # blocks of a cell: a table of one row for each cell, at most MAX_CENTRES
    sizes = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks")))
    stored = placed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64(F.lit("stored"), "id"), F.col("blocks")).cast("int"))
    seekers = looker(probes)(placed).select("id", "unit", F.explode("cells").alias("cell")).join(sizes, "cell")
    part = F.pmod(F.xxhash64(F.lit("seeker"), "id"), F.col("blocks")).cast("int")

    def every(blocks):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    left = seekers.withColumn("part", part).select("id", "unit", "cell", "part", every("blocks").alias("block"))
    right = stored.select(F.col("id").alias("to"), F.col("unit").alias("stored"), "cell", "block", every("blocks").alias("part"))

    def meet(key, a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["id", "neighbour", "cosine"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        order_a, order_b = np.argsort(a.column("id").to_numpy()), np.argsort(b.column("to").to_numpy())
        ids, mine = a.column("id").to_numpy()[order_a], b.column("to").to_numpy()[order_b]
        q, x = _matrix(a.column("unit").combine_chunks())[order_a], _matrix(b.column("stored").combine_chunks())[order_b]
        rows_, cols_, vals = [], [], []
        for lo in range(0, len(ids), 1024):
            scores = np.round(q[lo:lo + 1024] @ x.T, DIGITS)
            scores[ids[lo:lo + 1024, None] == mine[None, :]] = -np.inf
            r, c = _top(scores, mine, k)
            rows_.append(ids[lo + r]), cols_.append(mine[c]), vals.append(scores[r, c])
        return pa.table([pa.array(np.concatenate(rows_)), pa.array(np.concatenate(cols_)), pa.array(np.concatenate(vals))], names=names)

    by = ("cell", "part", "block")
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "id long, neighbour long, cosine double")
    near = save(_best(met, k).select(F.col("id").alias("node"), F.col("neighbour").alias("to"), "cosine"), "near")

    # back to rows: copies of a row's own vector, then the ids that stand for the nodes near by
    ids = nodes.select(F.col("id").alias("node"), "ids", "key", "unit")
    others = near.join(ids.select(F.col("node").alias("to"), "ids"), "to").select("node", F.explode("ids").alias("neighbour"), "cosine")
    own = ids.where(F.size("ids") > 1).select("node", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("cosine"))
    limit = Window.partitionBy("node").orderBy(F.col("cosine").desc(), "neighbour")
    lists = others.unionByName(own).withColumn("n", F.row_number().over(limit)).where(F.col("n") <= k + 1)
    per_node = lists.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbour"))).alias("list"))
    member = rows.join(ids.select("key", "unit", "node"), ["key", "unit"]).select("id", "node").join(per_node, "node")
    mine = F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("id")), 1, k)
    return member.select("id", F.posexplode(mine).alias("at", "x")).select(
        "id", (F.col("at") + 1).alias("rank"), F.col("x.neighbour").alias("neighbour"), (-F.col("x.far")).alias("cosine"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: true neighbours, how many of them ``found`` has for the same ids, and their share.

    An equally near row counts as found, whichever of several at the k-th place was listed.
    """
    floor = exact.groupBy("id").agg(F.min("cosine").alias("floor"), F.count("*").alias("n"))
    hit = (found.join(floor, "id").where(F.col("cosine") >= F.col("floor") - 1e-9).groupBy("id").agg(F.count("*").alias("hits")))
    return (floor.join(hit, "id", "left").agg(F.sum("n").alias("true_neighbours"), F.sum(F.least(F.coalesce("hits", F.lit(0)), "n")).alias("found"))
            .withColumn("recall", F.try_divide(F.col("found").cast("double"), F.col("true_neighbours"))))
