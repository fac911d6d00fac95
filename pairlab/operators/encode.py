"""Distributed embedding extraction: sequence text -> embedding, one encoder per task.

The encoder is pluggable: a factory returning ``encode(list[str]) -> list[np.ndarray]``.
The factory runs once per task (the expensive model load), then every Arrow batch of the
partition goes through it -- ``mapInPandas`` with state built before the loop. Every row
of a batch is embedded (no batch-size-1 restriction).

Built in: a deterministic *composition* encoder (each character is a one-hot token over
``codepoint mod dim``; the pooled vector is the character-class composition). No language
model weights ship here; a real encoder plugs in through the same factory interface.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType, StructField, StructType

Encoder = Callable[[list], list]


def composition_encoder(dim: int = 64, per_token: bool = False, dtype=np.float64) -> Callable[[], Encoder]:
    def factory() -> Encoder:
        def encode(seqs: list) -> list:
            out = []
            for s in seqs:
                if s is None:
                    out.append(None)
                    continue
                cp = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32) % dim
                if per_token:
                    tok = np.zeros((len(cp), dim), dtype=dtype)
                    tok[np.arange(len(cp)), cp] = 1.0
                    out.append(tok)
                else:
                    counts = np.bincount(cp, minlength=dim).astype(dtype)
                    out.append(counts / max(len(cp), 1))
            return out
        return encode
    return factory


ENCODERS: dict[str, Callable[..., Callable[[], Encoder]]] = {"composition": composition_encoder}


@lru_cache
def _built(name: str, params: tuple) -> Encoder:
    """One encoder for each worker process and setting, however many tasks it runs."""
    return ENCODERS[name](**dict(params))()


class NamedEncoder:
    """Encoder factory that travels to the tasks by name; a worker loads the model once."""

    def __init__(self, name: str, params: dict):
        self.name, self.params = name, tuple(sorted(params.items()))

    def __call__(self) -> Encoder:
        return _built(self.name, self.params)


def get_encoder(name: str, **params) -> Callable[[], Encoder]:
    """Encoder factory by name (case-insensitive substring match); unknown -> ValueError."""
    key = name.lower()
    for k in ENCODERS:
        if k in key:
            return NamedEncoder(k, params)
    raise ValueError(f"unknown encoder {name!r}; choose from: {', '.join(sorted(ENCODERS))}")


def extract_embeddings(df: DataFrame, seq_col: str, encoder: Callable[[], Encoder],
                       out: str = "embedding", per_token: bool = False,
                       dtype=DoubleType()) -> DataFrame:
    """Append the embedding of ``seq_col``: pooled ARRAY<dtype>, or with ``per_token``
    the tensor layout STRUCT<data ARRAY<dtype>, shape ARRAY<BIGINT>>."""
    if per_token:
        field = StructField(out, StructType([StructField("data", ArrayType(dtype)),
                                             StructField("shape", ArrayType(LongType()))]))
    else:
        field = StructField(out, ArrayType(dtype))
    schema = StructType(df.schema.fields + [field])
    np_type = np.float32 if isinstance(dtype, FloatType) else np.float64

    def run(batches):
        enc = encoder()
        for pdf in batches:
            vecs = enc(pdf[seq_col].tolist())
            if per_token:
                pdf[out] = [None if v is None else {"data": v.astype(np_type).ravel(), "shape": list(v.shape)}
                            for v in vecs]
            else:
                pdf[out] = [None if v is None else v.astype(np_type) for v in vecs]
            yield pdf

    return df.mapInPandas(run, schema)


#: Characters that one encoder call takes, padding counted: rows of a call times its longest sequence.
TOKEN_BUDGET = 1 << 16


def packs(lengths: list[int], budget: int = TOKEN_BUDGET):
    """(first, end) of runs whose number times longest length stays in the budget; a longer sequence comes alone."""
    lo, longest = 0, 0
    for i, n in enumerate(lengths):
        longest = max(longest, n)
        if i > lo and (i + 1 - lo) * longest > budget:
            yield lo, i
            lo, longest = i, n
    if lo < len(lengths):
        yield lo, len(lengths)


def extract_once(df: DataFrame, seq_col: str, encoder: Callable[[], Encoder], out: str = "embedding", dtype=DoubleType(),
                 budget: int = TOKEN_BUDGET, calls=None) -> DataFrame:
    """``extract_embeddings`` (pooled) that encodes every distinct sequence once.

    The distinct sequences are sorted by length within their partitions and handed to the encoder in packs of about equal
    lengths under a token budget, so little of a call is padding; the vectors are joined back on the sequence. NULL has no
    vector. ``calls`` is an accumulator that counts the sequences given to the encoder (again after a lost task).
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    np_type = np.float32 if isinstance(dtype, FloatType) else np.float64
    schema = StructType([StructField("_seq", df.schema[seq_col].dataType), StructField(out, ArrayType(dtype))])
    distinct = df.select(F.col(seq_col).alias("_seq")).where(F.col("_seq").isNotNull()).distinct().sortWithinPartitions(F.length("_seq"), "_seq")

    def run(batches):
        enc = encoder()
        for batch in batches:
            seqs = batch.column(0).to_pylist()
            for lo, hi in packs([len(s) for s in seqs], budget):
                vecs = [np.asarray(v, np_type) for v in enc(seqs[lo:hi])]
                if calls is not None:
                    calls.add(hi - lo)
                ends = np.concatenate([[0], np.cumsum([len(v) for v in vecs])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(vecs)))],
                                                 names=["_seq", out])

    coded = distinct.mapInArrow(run, schema)
    return df.join(coded, df[seq_col] == coded["_seq"], "left").drop("_seq")
