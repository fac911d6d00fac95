"""Scorers and trainers.

* MLP forward / MC-dropout scoring: ``mapInPandas`` over Arrow batches; the weights (model
  sized, independent of the data) are a broadcast variable; numpy does the matrix work.
  Dropout masks come from a counter hash of (seed, pass, row_id, layer, unit), so a
  row's score does not depend on which rows share its batch or partition.
* MLP training: data parallel. Each epoch is one Spark job: every task returns the gradient
  sum over its rows as fixed-size chunks, chunks are summed by a grouped aggregate (a
  reduce-scatter over the executors), and only model-sized vectors reach the driver,
  which applies the Adam step.
* Forest: ``operators/forest.py``; KMeans: Spark ML.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pairlab.functions.scores import binary_entropy
from pairlab.operators import forest as FR

# ---------------------------------------------------------------- weights


@dataclass
class MlpWeights:
    """Dense layers; hidden layers use ReLU (+dropout at train / MC time), last layer is a logit."""

    layers: list = field(default_factory=list)   # [(W (in, out), b (out,)), ...]

    def flat(self) -> np.ndarray:
        return np.concatenate([np.concatenate([w.ravel(), b.ravel()]) for w, b in self.layers])

    def shapes(self):
        return [(w.shape, b.shape) for w, b in self.layers]

    @staticmethod
    def unflat(vec: np.ndarray, shapes) -> "MlpWeights":
        out, i = [], 0
        for ws, bs in shapes:
            nw, nb = int(np.prod(ws)), int(np.prod(bs))
            out.append((vec[i:i + nw].reshape(ws), vec[i + nw:i + nw + nb].reshape(bs)))
            i += nw + nb
        return MlpWeights(out)


def init_mlp(sizes: list[int], seed: int = 0) -> MlpWeights:
    """Uniform(-1/sqrt(fan_in), 1/sqrt(fan_in)) init for a chain of dense layers."""
    rng = np.random.default_rng(seed)
    layers = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        k = 1.0 / np.sqrt(a)
        layers.append((rng.uniform(-k, k, (a, b)), rng.uniform(-k, k, (b,))))
    return MlpWeights(layers)


def rule_weights(sizes: list[int]) -> MlpWeights:
    """Deterministic weights from a closed-form rule, for exact cross-engine checks:
    W[k, j] = 0.1 * sin(0.37 k + 0.11 j + 0.5 l), b[j] = 0.01 j - 0.05 (l = layer index)."""
    layers = []
    for li, (a, b) in enumerate(zip(sizes[:-1], sizes[1:])):
        k = np.arange(a)[:, None]
        j = np.arange(b)[None, :]
        layers.append((0.1 * np.sin(0.37 * k + 0.11 * j + 0.5 * li), 0.01 * np.arange(b) - 0.05))
    return MlpWeights(layers)


# ---------------------------------------------------------------- dropout masks
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


#: Units of a dropout mask that are hashed at once.
MASK_CELLS = 1 << 14


def keep_mask(row_ids: np.ndarray, units: int, seed: int, pass_: int, layer: int, rate: float) -> np.ndarray:
    """Bernoulli(1-rate) keep mask of shape (rows, units) from a counter hash (splitmix64)."""
    if rate >= 1.0:
        return np.zeros((len(row_ids), units), bool)
    with np.errstate(over="ignore"):
        key = np.uint64((seed * 1_000_003 + pass_ * 7_919 + layer * 104_729) & 0xFFFFFFFFFFFFFFFF)
        r = _mix(row_ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) ^ key)
        u = np.arange(units, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
        # (_mix(r + u) >> 11) / 2^53 >= rate, in whole numbers and in place, for few enough rows to stay in a core's cache
        least = np.uint64(math.ceil(max(rate, 0.0) * (1 << 53)) << 11)
        out, step = np.empty((len(r), units), bool), max(1, MASK_CELLS // units)
        h, t = np.empty((step, units), np.uint64), np.empty((step, units), np.uint64)
        for i in range(0, len(r), step):
            rows = r[i:i + step]
            a, b = h[:len(rows)], t[:len(rows)]
            np.add(rows, u, out=a)
            np.right_shift(a, np.uint64(30), out=b)
            a ^= b
            a *= _M1
            np.right_shift(a, np.uint64(27), out=b)
            a ^= b
            a *= _M2
            np.right_shift(a, np.uint64(31), out=b)
            a ^= b
            np.greater_equal(a, least, out=out[i:i + step])
    return out


def _room(room: dict | None, name, shape: tuple[int, int]) -> np.ndarray:
    """An array to write to: with ``room`` always the same one, as new ones of this size cost as much as the arithmetic."""
    if room is None:
        return np.empty(shape)
    if name not in room or len(room[name]) < shape[0]:
        room[name] = np.empty(shape)
    return room[name][:shape[0]]


def forward(w: MlpWeights, x: np.ndarray, row_ids: np.ndarray | None = None, rate: float = 0.0,
            seed: int = 0, pass_: int = 0, keep: bool = False, room: dict | None = None):
    """Logits (n,), and with ``keep`` the activations and each hidden layer's factor of the units kept (for backprop): a unit that was
    dropped has activation 0, as one that its ReLU shut. With ``room`` they hold until the next call with it."""
    acts, masks = [x], []
    h = x
    for li, (W, b) in enumerate(w.layers):
        z = np.matmul(h, W, out=_room(room, ("z", li), (len(h), W.shape[1])))
        z += b
        if li == len(w.layers) - 1:
            return (z[:, 0], acts, masks) if keep else z[:, 0]
        h = np.maximum(z, 0.0, out=z)
        if rate > 0 and row_ids is not None:
            h *= keep_mask(row_ids, h.shape[1], seed, pass_, li, rate)
            h *= 1.0 / (1.0 - rate)
            masks.append(1.0 / (1.0 - rate))
        else:
            masks.append(None)
        acts.append(h)
    raise ValueError("empty network")


def _matrix(col) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col]) if len(col) else np.zeros((0, 0))


#: Rows that a network takes at once: their hidden units stay in a core's cache.
BLOCK = 512


def _table(col) -> np.ndarray:
    """The vectors of an Arrow list column as the rows of a matrix, without a Python object for each."""
    width = np.diff(col.offsets.to_numpy())
    if col.null_count or (len(width) and (width != width[0]).any()):
        raise ValueError("all vectors must have the same length")
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), -1)


def _numbers(col) -> np.ndarray:
    """An Arrow column as numpy values; with nulls it is one of floats, and these are NaN."""
    return col.to_numpy(zero_copy_only=False)


def _blocks(n: int):
    return [slice(i, min(i + BLOCK, n)) for i in range(0, n, BLOCK)]


# ---------------------------------------------------------------- scoring
def mlp_score(df: DataFrame, weights: MlpWeights, x: str, id_col: str = "row_id") -> DataFrame:
    """Deterministic forward pass (dropout off): (id, logit, p)."""
    bw = df.sparkSession.sparkContext.broadcast(weights)
    schema = StructType([StructField(id_col, LongType()), StructField("logit", DoubleType()),
                         StructField("p", DoubleType())])

    def run(batches):
        w = bw.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            z = forward(w, _matrix(pdf[x]))
            yield pdf[[id_col]].assign(logit=z, p=1.0 / (1.0 + np.exp(-z)))

    return df.select(id_col, x).mapInPandas(run, schema)


def mc_dropout_score(df: DataFrame, weights: MlpWeights, x: str, passes: int = 20, rate: float = 0.3,
                     seed: int = 0, id_col: str = "row_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """K stochastic passes per row inside the task: ``keep`` columns and the summary (mean_p, var_p, std_p,
    entropy), without any shuffle."""
    bw = df.sparkSession.sparkContext.broadcast(weights)
    df = df.select(id_col, x, *[c for c in keep if c != x])
    stats = ("mean_p", "var_p", "std_p")
    schema = StructType([f for f in df.schema.fields if f.name == id_col or f.name in keep]
                        + [StructField(c, DoubleType()) for c in stats])

    def run(batches):
        import pyarrow as pa
        w = bw.value
        for batch in batches:
            if len(batch) == 0:
                continue
            X, ids = _table(batch[x]), _numbers(batch[id_col])
            P, room = np.empty((len(X), passes)), {}
            for part in _blocks(len(X)):
                for k in range(passes):
                    P[part, k] = 1.0 / (1.0 + np.exp(-forward(w, X[part], ids[part], rate, seed, k, room=room)))
            names = [c for c in batch.schema.names if c == id_col or c in keep]
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(v) for v in (P.mean(axis=1), P.var(axis=1), P.std(axis=1))],
                                             names=[*names, *stats])

    return df.mapInArrow(run, schema).withColumn("entropy", binary_entropy("mean_p"))


# ---------------------------------------------------------------- frozen batch normalisation
@dataclass
class BatchNorm:
    """Normalisation of one hidden layer before its ReLU: scale and shift of every unit."""

    gamma: np.ndarray
    beta: np.ndarray
    eps: float = 1e-5


def _unit_sums(df: DataFrame, weights: MlpWeights, layer: int, x: str, centre: np.ndarray, power: int) -> tuple[int, np.ndarray]:
    """Rows, and for every unit of a hidden layer the sum of (value before ReLU - centre) ** power: one job, summed in the
    tasks first, so that a task sends one row for each unit."""
    schema = StructType([StructField("unit", LongType()), StructField("n", LongType()), StructField("s", DoubleType())])
    bw = df.sparkSession.sparkContext.broadcast((MlpWeights(weights.layers[:layer + 1]), centre))

    def run(batches):
        import pandas as pd
        net, c = bw.value
        W, b = net.layers[layer]
        n, total = 0, np.zeros(len(c))
        for pdf in batches:
            if len(pdf) == 0:
                continue
            h = _matrix(pdf[x])
            for V, a in net.layers[:layer]:
                h = np.maximum(h @ V + a, 0.0)
            n += len(h)
            total += ((h @ W + b - c) ** power).sum(axis=0)
        if n:
            yield pd.DataFrame({"unit": np.arange(len(c)), "n": n, "s": total})

    rows = df.select(x).mapInPandas(run, schema).groupBy("unit").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()   # one row a unit
    bw.unpersist()
    out = np.zeros(len(centre))
    for r in rows:
        out[r["unit"]] = r["s"]
    return (rows[0]["n"] if rows else 0), out


def batch_moments(df: DataFrame, weights: MlpWeights, x: str, layer: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance of every unit of a hidden layer before its ReLU, over all rows of ``df``; dropout off.
    The variance is summed around the mean in a second job, so large means lose no digits. No rows: means 0, variances 1."""
    units = len(weights.layers[layer][1])
    n, total = _unit_sums(df, weights, layer, x, np.zeros(units), 1)
    if n == 0:
        return np.zeros(units), np.ones(units)
    mean = total / n
    return mean, _unit_sums(df, weights, layer, x, mean, 2)[1] / n


def freeze_batchnorm(df: DataFrame, weights: MlpWeights, norms: dict[int, BatchNorm], x: str) -> MlpWeights:
    """Batch normalisation of the hidden layers in ``norms``, frozen at the moments of ``df``, folded into the dense layers.

    Layers are taken in order, so the moments of a later one see the earlier ones normalised. The result is a plain network:
    ``mlp_score``, ``mc_dropout_score`` (whose dropout stays on) and the writers take it as it is, and a row's score does not
    depend on the rows scored with it. A unit without variance scores ``beta``, but for rounding.
    """
    layers = list(weights.layers)
    for layer in sorted(norms):
        if not 0 <= layer < len(layers) - 1:
            raise ValueError(f"layer {layer} is not a hidden layer")
        mean, var = batch_moments(df, MlpWeights(layers), x, layer)
        norm, (W, b) = norms[layer], layers[layer]
        scale = norm.gamma / np.sqrt(var + norm.eps)
        layers[layer] = (W * scale, (b - mean) * scale + norm.beta)
    return MlpWeights(layers)


# ---------------------------------------------------------------- data-parallel training
CHUNK = 4096


def bootstrap_weights(row_ids: np.ndarray, seed: int, model: int, most: int = 8) -> np.ndarray:
    """Poisson(1) draws, one for each row, from a counter hash: how often a bootstrap sample holds the row."""
    with np.errstate(over="ignore"):
        key = np.uint64((seed * 1_000_003 + model * 15_485_863 + 1) & 0xFFFFFFFFFFFFFFFF)
        h = _mix(_mix(row_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ key))
    u = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    steps = np.cumsum(np.cumprod(np.concatenate([[1.0], 1.0 / np.arange(1, most)]))) / np.e
    return np.searchsorted(steps, u, "right").astype(np.float64)


def _gradient(w: MlpWeights, X, Y, ids, weight, pos_weight: float, rate: float, seed: int, epoch: int, room: dict | None = None):
    """(weighted sum of gradients, weighted loss sum) of some rows for one network; with ``room`` the sums hold until the next call."""
    z, acts, masks = forward(w, X, ids, rate, seed, epoch, keep=True, room=room)
    # d/dz of pw*y*softplus(-z) + (1-y)*softplus(z)
    s = 1.0 / (1.0 + np.exp(-z))
    dz = ((1.0 - Y) * s - pos_weight * Y * (1.0 - s)) * weight
    loss = (pos_weight * Y * np.logaddexp(0, -z) + (1.0 - Y) * np.logaddexp(0, z)) * weight
    sums = _room(room, "sums", (sum(W.size + b.size for W, b in w.layers), 1))[:, 0]
    delta, end = dz[:, None], len(sums)
    for li in range(len(w.layers) - 1, -1, -1):
        W, b = w.layers[li]
        start = end - W.size - b.size
        np.matmul(acts[li].T, delta, out=sums[start:end - b.size].reshape(W.shape))
        sums[end - b.size:end] = delta.sum(axis=0)
        end = start
        if li > 0:
            delta = np.matmul(delta, W.T, out=_room(room, ("delta", li), (len(X), len(W))))
            delta *= acts[li] > 0
            if masks[li - 1] is not None:
                delta *= masks[li - 1]
    return sums, float(loss.sum())


#: Sums of one pass and model besides the gradient: training loss and weight, validation loss, right decisions and rows.
SUMS = ("loss", "n", "val_loss", "val_right", "val_n")


def _pass(df: DataFrame, models: list[MlpWeights], x: str, y: str, id_col: str, pos_weight: float, rate: float,
          seeds: list[int], epoch: int, bootstrap: bool, val: str | None) -> list[tuple[np.ndarray, dict]]:
    """One Spark job over the table: for every model the gradient sum over its training rows and the sums of ``SUMS``,
    validation rows (``val`` true) scored without dropout by the same weights."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    schema = StructType([StructField("model", LongType()), StructField("chunk", LongType()), StructField("g", ArrayType(DoubleType()))])
    n_params = models[0].flat().size
    bw = df.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        import pyarrow as pa
        nets, room = bw.value, {}
        grads, sums = np.zeros((len(nets), n_params)), np.zeros((len(nets), len(SUMS)))
        for batch in batches:
            X, Y, ids = _table(batch[x]), _numbers(batch[y]).astype(np.float64), _numbers(batch[id_col])
            held = _numbers(batch[val]).astype(bool) if val else np.zeros(len(X), bool)
            for rows, score in ((np.flatnonzero(held), True), (np.flatnonzero(~held), False)):
                for part in _blocks(len(rows)):
                    of = rows[part] if val else part   # without validation rows a block is a view
                    xs, t = X[of], Y[of]
                    for k, w in enumerate(nets):
                        if score:
                            z = forward(w, xs, room=room)
                            sums[k, 2:] += (np.logaddexp(0, z) - t * z).sum(), ((z >= 0) == (t == 1)).sum(), len(t)
                        else:
                            weight = bootstrap_weights(ids[of], seeds[k], k) if bootstrap else np.ones(len(t))
                            g, loss = _gradient(w, xs, t, ids[of], weight, pos_weight, rate, seeds[k], epoch, room)
                            grads[k] += g
                            sums[k, :2] += loss, weight.sum()

        def chunk(k, c, g):
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([c], pa.int64()), pa.array([g], pa.list_(pa.float64()))],
                                              names=["model", "chunk", "g"])

        for k in range(len(nets)):
            yield chunk(k, -1, sums[k])
            for c in range(0, n_params, CHUNK):
                yield chunk(k, c // CHUNK, grads[k, c:c + CHUNK])

    parts = df.select(id_col, x, y, *([val] if val else [])).mapInArrow(run, schema)
    summed = parts.groupBy("model", "chunk").agg(Summarizer.sum(array_to_vector("g")).alias("s")).select("model", "chunk", vector_to_array("s").alias("s"))
    rows = {(r["model"], r["chunk"]): np.asarray(r["s"]) for r in summed.collect()}   # model sized
    bw.unpersist()
    out = []
    for k in range(len(models)):
        chunks = [rows[key] for key in sorted(key for key in rows if key[0] == k and key[1] >= 0)]
        out.append((np.concatenate(chunks) if chunks else np.zeros(n_params), dict(zip(SUMS, rows.get((k, -1), np.zeros(len(SUMS))).tolist()))))
    return out


def _train(df: DataFrame, x: str, y: str, hidden, epochs: int, lr: float, weight_decay: float, dropout: float, seeds: list[int],
           id_col: str, pos_weight: float | None, in_dim: int | None, bootstrap: bool, val: str | None):
    """Adam for every model, all of them in the same passes. Returns the weights after the last epoch, the history
    [(model, epoch, loss, val_loss, val_acc)] and, with ``val``, the weights of each model's best epoch."""
    if in_dim is None:
        in_dim = int(df.select(F.max(F.size(x))).first()[0])
    if pos_weight is None:
        fit = df.where(~F.col(val)) if val else df
        c = fit.agg(F.count_if(F.col(y) == 0).alias("neg"), F.count_if(F.col(y) == 1).alias("pos")).first()
        pos_weight = c["neg"] / max(c["pos"], 1)
    models = [init_mlp([in_dim, *hidden, 1], s) for s in seeds]
    shapes = models[0].shapes()
    theta = [w.flat() for w in models]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    best: list = [None] * len(seeds)
    b1, b2, eps = 0.9, 0.999, 1e-8
    history, loss = [], [0.0] * len(seeds)
    # a pass scores the validation rows with the weights that the epoch before it left, so one more ends the last epoch
    for t in range(1, epochs + 1 + (val is not None)):
        for k, (g, s) in enumerate(_pass(df, models, x, y, id_col, pos_weight, dropout, seeds, t, bootstrap, val)):
            if val and t > 1:
                acc = s["val_right"] / max(s["val_n"], 1)
                history.append((k, t - 1, loss[k], s["val_loss"] / max(s["val_n"], 1), acc))
                if best[k] is None or acc > best[k][0]:
                    best[k] = (acc, t - 1, models[k])
            if t > epochs or s["n"] == 0:
                continue
            loss[k] = s["loss"] / s["n"]
            if not val:
                history.append((k, t, loss[k], None, None))
            g = g / s["n"] + weight_decay * theta[k]
            m[k] = b1 * m[k] + (1 - b1) * g
            v[k] = b2 * v[k] + (1 - b2) * g * g
            theta[k] = theta[k] - lr * (m[k] / (1 - b1 ** t)) / (np.sqrt(v[k] / (1 - b2 ** t)) + eps)
        models = [MlpWeights.unflat(p, shapes) for p in theta]
    return models, history, best


def train_mlp(df: DataFrame, x: str, y: str = "label", hidden=(256, 128), epochs: int = 30,
              lr: float = 1e-3, weight_decay: float = 1e-4, dropout: float = 0.3, seed: int = 0,
              id_col: str = "row_id", pos_weight: float | None = None, in_dim: int | None = None):
    """Full-batch Adam on BCE-with-logits (positive weight n_neg / max(n_pos, 1)).

    Full batch is exact data parallelism: the gradient is a sum over rows, so it is summed
    over tasks. ``df`` should be a materialised (checkpointed or written) table because it
    is read once per epoch. Returns (weights, [(epoch, mean loss)]).
    """
    models, history, _ = _train(df, x, y, hidden, epochs, lr, weight_decay, dropout, [seed], id_col, pos_weight, in_dim, False, None)
    return models[0], [(e, loss) for _, e, loss, _, _ in history]


def train_mlp_best(df: DataFrame, val: str, x: str, y: str = "label", hidden=(256, 128), epochs: int = 30, lr: float = 1e-3,
                   weight_decay: float = 1e-4, dropout: float = 0.3, seed: int = 0, id_col: str = "row_id", in_dim: int | None = None):
    """``train_mlp`` on the rows whose ``val`` is false, keeping the epoch with the best accuracy on the others (the first of
    equals). Each pass is one job that returns the gradient sum and the validation sums together.

    Returns (weights of the best epoch, best epoch, [(epoch, train_loss, val_loss, val_acc)]).
    """
    _, history, best = _train(df, x, y, hidden, epochs, lr, weight_decay, dropout, [seed], id_col, None, in_dim, False, val)
    _, epoch, weights = best[0]
    return weights, epoch, [row[1:] for row in history]


def train_ensemble(df: DataFrame, x: str, y: str = "label", k: int = 5, hidden=(256, 128), epochs: int = 30, lr: float = 1e-3,
                   weight_decay: float = 1e-4, dropout: float = 0.3, seed: int = 0, id_col: str = "row_id", in_dim: int | None = None):
    """K networks on K bootstrap samples, in the passes of one: a row's K weights are Poisson(1) hashes of (seed, model,
    row), so the samples do not depend on partitions. Returns (list of weights, [(model, epoch, mean loss)])."""
    models, history, _ = _train(df, x, y, hidden, epochs, lr, weight_decay, dropout, [seed + i for i in range(k)], id_col, None, in_dim, True, None)
    return models, [(i, e, loss) for i, e, loss, _, _ in history]


def ensemble_score(df: DataFrame, models: list[MlpWeights], x: str, id_col: str = "row_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, mean_p, var_p (population variance over the models) and the entropy of the mean, without a shuffle."""
    bw = df.sparkSession.sparkContext.broadcast(models)
    df = df.select(id_col, x, *[c for c in keep if c != x])
    schema = StructType([f for f in df.schema.fields if f.name == id_col or f.name in keep] + [StructField(c, DoubleType()) for c in ("mean_p", "var_p")])

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            if len(batch) == 0:
                continue
            X = _table(batch[x])
            P, room = np.empty((len(X), len(bw.value))), {}
            for part in _blocks(len(X)):
                for k, w in enumerate(bw.value):
                    P[part, k] = 1.0 / (1.0 + np.exp(-forward(w, X[part], room=room)))
            names = [c for c in batch.schema.names if c == id_col or c in keep]
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(v) for v in (P.mean(axis=1), P.var(axis=1))],
                                             names=[*names, "mean_p", "var_p"])

    return df.mapInArrow(run, schema).withColumn("entropy", binary_entropy("mean_p"))


# ---------------------------------------------------------------- forest, and kmeans (Spark ML)
def train_forest(df: DataFrame, x: str, y: str = "label", num_trees: int = 200, min_leaf: int = 1,
                 max_depth: int = 30, seed: int = 42, balanced: bool = True, id_col: str = "row_id") -> FR.Forest:
    """Random forest (Gini, Poisson bootstrap, ceil(sqrt(d)) features a node) with balanced class weights n / (k n_c)."""
    return FR.fit(df, x, y, num_trees, min_leaf, max_depth, seed, balanced, id_col)


def forest_predict(model: FR.Forest, df: DataFrame, x: str, id_col: str = "row_id", leaves: bool = False,
                   keep_x: bool = False) -> DataFrame:
    """The other columns of ``df`` and p, the forest's class-1 probability; with ``leaves`` also the leaf per tree."""
    return FR.predict(model, df, x, leaves, keep_x)


def forest_leaves_long(pred: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(row_id, tree, leaf) long table from the per-tree leaf array."""
    return pred.select(id_col, F.posexplode("leaves").alias("tree", "leaf")).withColumn(
        "leaf", F.col("leaf").cast("long"))


def canonical(df: DataFrame, id_col: str = "row_id", parts: int = 8) -> DataFrame:
    """Rows laid out by a hash of their id and sorted: Spark ML draws its samples by partition and order, so a
    fit depends on the layout of its (bounded) training rows unless that is fixed."""
    return df.repartition(parts, id_col).sortWithinPartitions(id_col)


def kmeans_best(df: DataFrame, x: str, k: int, seed: int = 42, restarts: int = 3):
    """KMeans(k) from ``restarts`` seeds, keeping the lowest training cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    d = canonical(df).withColumn("_v", array_to_vector(x))
    best = None
    for r in range(restarts):
        model = KMeans(k=k, seed=seed + r, featuresCol="_v", predictionCol="cluster").fit(d)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best
