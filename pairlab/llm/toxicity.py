"""Toxicity of texts: a factorization machine over hashed terms.

Terms of a text are its distinct words (runs of letters, digits and non-ASCII bytes; A-Z lower-cased) and the
stems of these, their first ``STEMS`` bytes, so that inflected forms share a term; a stem counts again as another
term where ``LEVELS`` distinct words have it. A term's slot is a hash of ``BITS`` bits. A text with the slots S has the logit

    bias + sum of weight[i] + sum over pairs i < j of <factor[i], factor[j]>      (i, j in S)

so two terms can tell together what neither tells alone, such as an insult and the mention of a group. The pair sum
costs one pass: half of |sum of factors|^2 - sum of |factor|^2.

Fit: on labelled rows whose crc32 of the decimal doc_id modulo 5 is not 0. The sample is chosen by a hash of
doc_id and bounded by ``SAMPLE_ROWS`` rows and ``SAMPLE_CHARS`` characters, so that one task can hold its slots; only slots
found in ``MIN_DOCS`` sampled texts, whose label depends on them by a likelihood ratio of ``MIN_RATIO``, carry weights. AdaGrad over minibatches in one task
gives at most 2^BITS weights and factors, 36 bytes each: what the driver passes on is bounded by that.
Scoring reads every whole text once, without a shuffle. Label, language, source and doc_id are no terms.

Defined cases: a null or empty text has no terms and gets the bias; without labelled rows of both kinds
every text gets the smoothed share of label 1; a null doc_id is never learned from and not held out; a doc_id
with several labels counts as toxic if one says so. Every input row gives one row.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm import flat
from pairlab.llm.scratch import Run

BITS = 20
STEMS = (4, 5, 6, 7)
LEVELS = (1, 2, 3)
FACTORS = 8
SAMPLE_ROWS = 20_000
SAMPLE_CHARS = 100_000_000
MIN_DOCS = 3
MIN_RATIO = 12.0
EPOCHS = 12
BATCH = 128
RATE = 0.1
DECAY = 1e-5
#: Bytes between words: ASCII that is neither letter nor digit.
GAP = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one, number) of every distinct (row, value)."""
    _, one, n = np.unique(flat.mix(value + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    return one, n


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def slots(buf: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct slots of every text, by row; only those marked in ``wanted`` where it is given."""
    low = flat.LOWER[buf]
    begin, end, row = flat.word_spans(low, offsets, GAP)
    sums = flat.prefix(low)
    word = flat.span_hash(sums, begin, end)
    one, _ = _distinct(row, word)
    begin, end, row, word = begin[one], end[one], row[one], word[one]
    rows, found = [row], [_slot(word)]
    for size in STEMS:
        long = end - begin >= size
        of, stem = row[long], flat.span_hash(sums, begin[long], begin[long] + size)
        if wanted is not None:  # all words of a stem stay or go together, so its count stays right
            use = np.logical_or.reduce([wanted[_slot(flat.mix(stem + np.uint64(level)))] for level in LEVELS])
            of, stem = of[use], stem[use]
        one, n = _distinct(of, stem)
        of, stem = of[one], stem[one]
        for level in LEVELS:
            rows.append(of[n >= level])
            found.append(_slot(flat.mix(stem[n >= level] + np.uint64(level))))
    row, slot = np.concatenate(rows).astype(np.int64), np.concatenate(found)
    if wanted is not None:
        use = wanted[slot]
        row, slot = row[use], slot[use]
    key = np.unique(row << BITS | slot)
    return key >> BITS, (key & ((1 << BITS) - 1)).astype(np.int32)


@dataclass(frozen=True)
class Machine:
    """Weights of the kept slots; ``place`` leads from a slot to its row, or to -1."""

    bias: float
    kept: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def place(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[self.kept] = np.arange(len(self.kept), dtype=np.int32)
        return out

    def logits(self, place: np.ndarray, row: np.ndarray, slot: np.ndarray, n_rows: int) -> np.ndarray:
        at = place[slot]
        known = at >= 0
        at, row = at[known], row[known]
        out = np.full(n_rows, self.bias)
        if not len(at):
            return out
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        of = row[first]
        out[of] += np.add.reduceat(self.weight[at], first, dtype=np.float64)
        for f in range(self.factor.shape[1]):  # one factor at a time, so that a long text takes little memory
            v = self.factor[:, f][at].astype(np.float64)
            out[of] += 0.5 * (np.add.reduceat(v, first) ** 2 - np.add.reduceat(v * v, first))
        return out


Part = tuple[np.ndarray, np.ndarray, np.ndarray]  # labels, numbers of slots, slots of some texts


def _telling(parts: list[Part]) -> np.ndarray:
    """Slots of at least ``MIN_DOCS`` texts whose label depends on them: likelihood ratio of at least ``MIN_RATIO``."""
    n = sum(len(labels) for labels, _, _ in parts)
    ones = sum(int(labels.sum()) for labels, _, _ in parts)
    have, hit = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for labels, size, slot in parts:
        have += np.bincount(slot, minlength=1 << BITS)
        hit += np.bincount(slot[np.repeat(labels == 1, size)], minlength=1 << BITS)

    def part(seen: np.ndarray, of: np.ndarray, share: float) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(of * share, 1e-12)), 0)

    ratio = 2 * (part(hit, have, ones / n) + part(have - hit, have, 1 - ones / n)
                 + part(ones - hit, n - have, ones / n) + part(n - ones - have + hit, n - have, 1 - ones / n))
    return np.flatnonzero((have >= MIN_DOCS) & (ratio >= MIN_RATIO)).astype(np.int32)


def fit(parts: list[Part], seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss. Slots that tell nothing are left out part by part, before anything is joined."""
    labels = np.concatenate([np.zeros(0, np.int64), *[p[0] for p in parts]])
    prior = (labels.sum() + 0.5) / (len(labels) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if not 0 < labels.sum() < len(labels):
        none = np.zeros(0, np.int32)
        return Machine(bias, none, none.astype(np.float32), np.zeros((0, FACTORS), np.float32))
    kept = _telling(parts)
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    found, sizes = [], []
    for _, size, slot in parts:
        at = place[slot]
        sizes.append(np.add.reduceat(np.append(at >= 0, False), np.cumsum(size) - size, dtype=np.int64) * (size > 0))
        found.append(at[at >= 0])
    at = np.concatenate(found)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    rnd = np.random.RandomState(seed)
    table = np.zeros((len(kept), 1 + FACTORS), np.float32)  # weight, then factors
    table[:, 1:] = rnd.normal(0, 0.01, (len(kept), FACTORS))
    seen = np.full(table.shape, 1.0, np.float32)  # sums of squared gradients; the start keeps first steps small
    bias_seen = 1.0
    for _ in range(EPOCHS):
        order = rnd.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            docs = order[lo:lo + BATCH]
            size = bounds[docs + 1] - bounds[docs]
            ends = np.cumsum(size)
            total = int(ends[-1])
            here = at[np.arange(total) + np.repeat(bounds[docs] - (ends - size), size)]
            doc = np.repeat(np.arange(len(docs)), size)
            used, inv = np.unique(here, return_inverse=True)
            part = table[used]
            x = part[inv]
            sums = np.zeros((len(docs), 1 + FACTORS))
            squares = np.zeros(len(docs))
            full = np.flatnonzero(size)
            if len(full):
                first = (ends - size)[full]
                sums[full] = np.add.reduceat(x, first, axis=0, dtype=np.float64)
                squares[full] = np.add.reduceat(np.square(x[:, 1:]).sum(1, dtype=np.float64), first)
            z = bias + sums[:, 0] + 0.5 * (np.square(sums[:, 1:]).sum(1) - squares)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[docs]
            grad = np.empty((len(used), 1 + FACTORS))
            e = err[doc]
            grad[:, 0] = np.bincount(inv, e, len(used))
            for f in range(1, 1 + FACTORS):
                grad[:, f] = np.bincount(inv, e * (sums[doc, f] - x[:, f]), len(used))
            grad += DECAY * len(docs) * part
            seen[used] += np.square(grad)
            table[used] = part - RATE * grad / np.sqrt(seen[used])
            g = err.sum()
            bias_seen += g * g
            bias -= RATE * g / np.sqrt(bias_seen)
    return Machine(float(bias), kept, np.ascontiguousarray(table[:, 0]), np.ascontiguousarray(table[:, 1:]))


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, text) of the labelled rows to learn from."""
    marked = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
              .agg(F.max("toxic").cast("int").alias("label")).filter(_fold() != 0))
    lengths = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    rows, chars = lengths.join(marked, "doc_id").agg(F.count("*"), F.sum("chars")).first()
    share = min(1.0, SAMPLE_ROWS / max(rows, 1), SAMPLE_CHARS / max(chars or 0, 1))
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000))
    # a broadcast of at most about SAMPLE_ROWS ids
    chosen = F.broadcast(marked.filter(draw < int(share * 1_000_000)))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").select("doc_id", "label", "text")


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    at = Run(docs.sparkSession, "toxicity")
    of_slots = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("label", T.IntegerType()),
                             T.StructField("slots", T.ArrayType(T.IntegerType()))])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in flat.chunks(batch.column(2)):
                row, slot = slots(buf, offsets)
                bounds = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                                                  pa.ListArray.from_arrays(pa.array(bounds), pa.array(slot))], names=of_slots.names)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            lists = batch.column(1)
            parts.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy()).astype(np.int64),
                          lists.flatten().to_numpy()))
        m = fit(parts)
        out = io.BytesIO()
        np.savez(out, bias=m.bias, kept=m.kept, weight=m.weight, factor=m.factor)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["machine"])

    given = at.save(sample(docs, labels).mapInArrow(terms, of_slots), "sample")
    # one task on purpose: the sample is bounded, and an order by doc_id makes reruns agree
    row = given.coalesce(1).sortWithinPartitions("doc_id", "label", F.xxhash64("slots")).select("label", "slots").mapInArrow(learn, "machine binary").first()
    at.drop("sample")
    if row is None:
        return fit([])
    got = np.load(io.BytesIO(row["machine"]))
    return Machine(float(got["bias"]), got["kept"], got["weight"], got["factor"])


def apply(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row."""
    out = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = m.place()
        for batch in batches:
            for lo, hi, buf, offsets in flat.chunks(batch.column(1)):
                row, slot = slots(buf, offsets, place >= 0)
                z = m.logits(place, row, slot, hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=out.names)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, out).withColumnRenamed("key", key)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return apply(docs, train(docs, labels)).select(
        "doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
