"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Every text becomes a vector of five transformed statistics: log words, log mean word length, and
log1p of the percentages of symbols, repeated lines and repeated 5-word windows. For each
(language, source) the MCD estimate is the mean and covariance of that share ``ALPHA`` of the
rows whose covariance has the smallest determinant. It is found by concentration steps from
several starts (median and MAD; small hash-chosen subsets), all run as grouped Spark
aggregations: distances, the exact ALPHA-quantile of each group, then the moments below it. A
reweighting step follows, and a text is rejected when its squared Mahalanobis distance passes
the chi-square quantile ``TAIL``.

Statistics are kept as whole thousandths, so that sums are exact and do not depend on the order
in which partitions are merged. Each distinct vector of a group counts once in the estimate;
a text copied a million times is no majority. A variance floor (``FLOOR``) keeps the
covariance regular where most texts have no symbol or no repeated line at all.

Defined cases. Null or empty text: no words, all counts 0, base rule fails, not kept. Null language
or source: a group like any other. Groups with fewer than ``MIN_GROUP`` distinct vectors take the estimate of all
vectors of their language, large groups included, or if those are too few that of all vectors; if all
are too few, texts are kept unless the base rule fails. Repeated rows get one result row each. Empty input: no rows. Other
columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm import flat
from pairlab.llm.scratch import Run

SCALE = 1000
ALPHA = 0.75
STARTS = 3
STEPS = 4
SUBSET = 24
MIN_GROUP = 60
TAIL = 0.9999
#: Least standard deviations of the five statistics. Most texts have no symbol, repeated line or repeated window, so in
#: these dimensions the floor is nearly the whole variance and says how much is ordinary: a line of a few dozen words that
#: stands twice in a page is no outlier. Each statistic alone can pass the cutoff (about 5.07 deviations): in a group
#: without any, symbols do from some 11.7 per cent on, repeated lines from 95, repeated windows from 16.
FLOOR = (0.2, 0.1, 0.5, 0.9, 0.56)
#: Groups whose parameters (about 300 bytes each) are broadcast at most.
BROADCAST_GROUPS = 20_000

P = len(FLOOR)
X = [f"x{i}" for i in range(P)]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
KEY = "_quality_key"


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The base counts and scaled statistics of a column of texts."""
    parts = [_measure(buf, offsets) for _, _, buf, offsets in flat.chunks(column)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
            for k in [*COUNTS, *X]}


def _measure(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    start, end, row = flat.word_spans(buf, offsets)
    sums = flat.prefix(buf)
    words = flat.span_hash(sums, start, end)
    n_words = np.bincount(row, minlength=n)
    chars = flat.per_row(~flat.SPACE[buf] & flat.LEADS[buf], offsets)
    symbols = flat.per_row(SYMBOLS[buf], offsets)

    # 5-word windows found twice or more in their text, and the words under them
    grams, at = flat.shingles(words, row, 5)
    _, which, times = np.unique(flat.mix(grams ^ flat.mix(row[at].astype(flat.U64))), return_inverse=True,
                                return_counts=True)
    twice = at[times[which] > 1]
    cover = np.zeros(len(row) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    repeated = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n)

    # lines with a word: those that hold the first byte of one
    cut = np.unique(np.concatenate([offsets, np.flatnonzero(buf == 10) + 1]))
    line = np.unique(np.searchsorted(cut, start, "right") - 1) if len(start) else np.zeros(0, np.int64)
    begin, stop = cut[line], cut[np.minimum(line + 1, len(cut) - 1)]
    stop = stop - (buf[stop - 1] == 10) if len(line) else stop
    of = np.searchsorted(offsets, begin, "right") - 1
    distinct = np.unique(flat.mix(flat.span_hash(sums, begin, stop) ^ flat.mix(of.astype(flat.U64))),
                         return_index=True)[1]
    lines = np.bincount(of, minlength=n)
    dup = lines - np.bincount(of[distinct], minlength=n)

    w, ln = np.maximum(n_words, 1), np.maximum(lines, 1)
    x = [np.log(w), np.log(np.maximum(chars, 1) / w), np.log1p(100 * symbols / w), np.log1p(100 * dup / ln),
         np.log1p(100 * repeated / w)]
    out = dict(zip(COUNTS, (n_words, chars, symbols, dup, repeated), strict=True))
    return out | {k: np.rint(v * SCALE).astype(np.int64) for k, v in zip(X, x, strict=True)}


def statistics(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, lang, source, a key of the row, counts and statistics."""
    own = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text", "lang", "source").alias(KEY))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, source string, {KEY} long, " + \
        ", ".join(f"{c} long" for c in [*COUNTS, *X])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(b.column("text"))
            keep = ["doc_id", "lang", "source", KEY]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(m[c]) for c in [*COUNTS, *X]],
                                             [*keep, *COUNTS, *X])

    return own.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function, by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return (lo + hi) / 2


#: Makes the covariance of the ALPHA most central rows consistent for normal data.
CONSISTENCY = ALPHA / chi2_cdf(chi2_quantile(ALPHA, P), P + 2)
REWEIGHT = chi2_quantile(0.975, P)
CUTOFF = chi2_quantile(TAIL, P)

_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_GROUP = ["g_lang", "g_source", "level"]
_PARAMS = "g_lang string, g_source string, level int, start int, n long, logdet double, centre array<double>, " \
    "inverse array<double>"


def _estimate(factor: float):
    """Turns grouped sums into centres and inverse covariances."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                n, mean = r["n"], np.array([r[f"s{i}"] for i in range(P)], float) / r["n"]
                cov = np.zeros((P, P))
                for i, j in _PAIRS:
                    cov[i, j] = cov[j, i] = r[f"c{i}{j}"] / n - mean[i] * mean[j]
                cov = factor * cov / SCALE ** 2 + np.diag(np.square(FLOOR))
                rows.append({**{k: r[k] for k in [*_GROUP, "start", "n"]}, "logdet": np.linalg.slogdet(cov)[1],
                             "centre": list(mean / SCALE), "inverse": list(np.linalg.inv(cov).ravel())})
            yield pd.DataFrame(rows, columns=[*_GROUP, "start", "n", "logdet", "centre", "inverse"])

    return run


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    sums = [F.sum(X[i]).alias(f"s{i}") for i in range(P)]
    cross = [F.sum(F.col(X[i]) * F.col(X[j])).cast("double").alias(f"c{i}{j}") for i, j in _PAIRS]
    out = rows.groupBy(*_GROUP, "start").agg(F.count("*").alias("n"), *sums, *cross)
    return out.mapInPandas(_estimate(factor), _PARAMS)


def _distance() -> Column:
    """Squared Mahalanobis distance from the joined parameters."""
    d = [F.col(X[i]) / SCALE - F.col("centre")[i] for i in range(P)]
    terms = [F.col("inverse")[i * P + j] * d[i] * d[j] * (1 if i == j else 2) for i, j in _PAIRS]
    return reduce(lambda a, b: a + b, terms)


def _bounded(side: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(side) if rows <= BROADCAST_GROUPS else side


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the keys of ``right`` go."""
    renamed = right.select(*[F.col(k).alias(f"r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"r_{k}" for k in keys])


def groups(points: DataFrame) -> DataFrame:
    """Group of every (lang, source): its own, all of its language or all, by the number of distinct vectors."""
    n = points.groupBy("lang", "source").agg(F.count("*").alias("n"))
    pools = points.select("lang", *X).distinct().groupBy("lang").agg(F.count("*").alias("pool"))
    n = _same(n, pools, ["lang"])
    n = n.withColumn("level", F.when(F.col("n") >= MIN_GROUP, 0).when(F.col("pool") >= MIN_GROUP, 1).otherwise(2))
    return n.select("lang", "source", F.when(F.col("level") < 2, F.col("lang")).alias("g_lang"),
                    F.when(F.col("level") == 0, F.col("source")).alias("g_source"), "level")


def members(points: DataFrame, of: DataFrame, count: int) -> DataFrame:
    """The distinct vectors of every group in use; a pool has those of its large groups too."""
    own = _same(points, _bounded(of.filter("level = 0"), count), ["lang", "source"]).select(*_GROUP, *X)
    langs = of.filter("level = 1").select("lang", "g_lang", "g_source", "level").distinct()
    by_lang = _same(points.select("lang", *X).distinct(), _bounded(langs, count), ["lang"]).select(*_GROUP, *X)
    rest = of.filter("level = 2").select(*_GROUP).distinct()
    return own.unionByName(by_lang).unionByName(points.select(*X).distinct().crossJoin(F.broadcast(rest)).select(*_GROUP, *X))


def fit(stats: DataFrame, run: Run) -> tuple[DataFrame, DataFrame, int]:
    """(group of every (lang, source), MCD parameters of every group, number of (lang, source))."""
    points = run.save(stats.filter(~base_failed()).select("lang", "source", *X).distinct(), "points")
    of = run.save(groups(points), "groups")
    count = of.count()
    rows = members(points, of, count)
    sized = rows.groupBy(*_GROUP).agg(F.count("*").alias("size"))
    rows = run.save(_same(rows, _bounded(sized, count), _GROUP).filter(F.col("size") >= MIN_GROUP), "rows")

    # starts: the median with the MAD, and subsets of about SUBSET rows chosen by a hash
    middle = rows.groupBy(*_GROUP).agg(*[F.percentile(x, 0.5).alias(f"m_{x}") for x in X])
    off = _same(rows, _bounded(middle, count), _GROUP)
    spread = off.groupBy(*_GROUP).agg(
        F.count("*").alias("n"), F.array(*[F.first(f"m_{x}") / SCALE for x in X]).alias("centre"),
        F.array(*[F.percentile(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5) / SCALE * 1.4826 for x in X]).alias("mad"))
    zero = F.lit(0.0)
    spread = spread.select(
        *_GROUP, F.lit(0).alias("start"), "n", F.lit(0.0).alias("logdet"), "centre",
        F.array(*[1 / (F.col("mad")[i] * F.col("mad")[i] + FLOOR[i] ** 2) if i == j else zero
                  for i in range(P) for j in range(P)]).alias("inverse"))
    picked = reduce(DataFrame.unionByName, [
        rows.filter(F.pmod(F.xxhash64(F.lit(k), *X), F.greatest(F.lit(1), F.floor(F.col("size") / SUBSET))) == 0)
        .withColumn("start", F.lit(k)) for k in range(1, STARTS)])
    params = run.save(spread.unionByName(_moments(picked, 1.0)), "params-0")

    for step in range(STEPS):
        near = _same(rows, _bounded(params, count * STARTS), _GROUP).select(
            *_GROUP, "start", *X, F.least(F.floor(F.sqrt(_distance()) * SCALE), F.lit(1_000_000)).alias("d"))
        limit = near.groupBy(*_GROUP, "start").agg(F.percentile("d", ALPHA).alias("limit"))
        inner = _same(near, _bounded(limit, count * STARTS), [*_GROUP, "start"]).filter("d <= limit")
        params = run.save(_moments(inner, CONSISTENCY), f"params-{step + 1}")

    best = params.groupBy(*_GROUP).agg(F.min_by(F.struct("centre", "inverse", "start"), F.struct("logdet", "start")).alias("b"))
    best = best.select(*_GROUP, "b.centre", "b.inverse", "b.start")
    good = _same(rows, _bounded(best, count), _GROUP).filter(_distance() <= REWEIGHT)
    return of, run.save(_moments(good, 1.0), "params"), count


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed, kept, distance (squared; null without an estimate), row key."""
    run = Run(docs.sparkSession, "quality")
    stats = run.save(statistics(docs), "stats")
    of, params, count = fit(stats, run)
    rows = _same(stats, _bounded(of, count), ["lang", "source"], "left")
    rows = _same(rows, _bounded(params.select(*_GROUP, "centre", "inverse"), count), _GROUP, "left")
    far = F.coalesce(_distance() > CUTOFF, F.lit(False))
    return rows.select("doc_id", *COUNTS, base_failed().alias("base_failed"),
                       (~base_failed() & ~far).alias("kept"), _distance().alias("distance"), KEY)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    out = judge(docs).filter(~F.col("kept")).select(F.col(KEY).alias("_rejected")).distinct()
    key = F.xxhash64("text", "lang", "source")
    return docs.join(out, key == F.col("_rejected"), "left_anti")
