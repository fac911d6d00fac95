"""Token-ID output as ORC: encode every text, write the ids sorted by document, read them back.

File format: ORC with columns doc_id, pos (partition and row, rising with the order) and ids (array of int), all ids
integer run-length encoded (RLE version 2) by the writer; row indexes every ``STRIDE`` rows; Bloom filters on doc_id;
stripes of ``STRIPE`` bytes. Files are range-partitioned and sorted by doc_id, so readers split them by
stripe, and a filter on doc_id skips files and stripes by their statistics and Bloom filters.

Documents are range-partitioned as text, encoded after the sort, and written by the same tasks: ids, which
are larger than the text, are never shuffled. The vocabulary's pre-tokenizer never joins two sides of white space, nor a
letter a-z and a full stop or comma behind it, and it lower-cases; so a text's ids are those of its lower-cased
pieces one after another. Each worker encodes a distinct piece once and keeps it in a cache of at most ``CACHE`` pieces;
a full cache keeps the pieces that came in two chunks of text or more.

Defined cases. Null or empty text: only the end id. Null doc_ids come first. Rows with equal doc_id follow by
a hash of their text; equal rows are written as often as they come. Empty input: files without rows.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.llm import flat
from pairlab.llm.scratch import Run

END_ID = 1
STRIPE = 16 << 20
STRIDE = 1000
CACHE = 2_500_000
#: New pieces that are gathered before they are sorted in among the others.
FRESH = 200_000
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
STOP = np.zeros(256, bool)
STOP[[ord("."), ord(",")]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts, by way of their distinct words."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.ids = np.zeros(0, np.int32)
        #: Sorted hashes with the place of the ids, their number, and the chunks that had the piece; large and small.
        self.old, self.new = Pieces.none(), Pieces.none()

    def shrink(self) -> None:
        """Keeps the pieces of several chunks, or none if these are over half of the cache."""
        p = self.old.merged(self.new)
        p, ids = p.take(np.flatnonzero(p.seen > 1)), self.ids
        self.forget()
        if 2 * len(p.hash) <= CACHE:
            begin = np.cumsum(p.size) - p.size
            self.ids = ids[np.arange(p.size.sum()) + np.repeat(p.first - begin, p.size)]
            p.first, self.old = begin, p

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter((x for c in coded for x in c), np.int32, int(size.sum()))])
        self.new = self.new.merged(Pieces(hashes, first, size, np.zeros(len(hashes), np.int32)))
        if len(self.new.hash) > FRESH:
            self.old, self.new = self.old.merged(self.new), Pieces.none()

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, each with the end id; offsets)."""
        # a special token is one in lower case only
        low = buf if b"<|" in buf.tobytes() else flat.LOWER[buf]
        start, end, row = pieces(low, offsets)
        n = len(offsets) - 1
        hashes, index, which = np.unique(flat.span_hash(flat.prefix(low), start, end), return_index=True, return_inverse=True)
        if len(self.old.hash) + len(self.new.hash) + len(hashes) > CACHE:
            self.shrink()
        unknown = np.flatnonzero(~(self.old.has(hashes) | self.new.has(hashes)))
        if len(unknown):
            self.learn(hashes[unknown], flat.span_strings(low, start[index[unknown]], end[index[unknown]]).to_pylist())
        first, size = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for p in (self.old, self.new):
            known = np.flatnonzero(p.has(hashes))
            at = np.searchsorted(p.hash, hashes[known])
            p.seen[at] += 1
            first[known], size[known] = p.first[at], p.size[at]
        first, size = first[which], size[which]
        total = np.bincount(row, size, n).astype(np.int64) + 1
        out_offsets = np.concatenate([[0], np.cumsum(total)])
        out = np.full(out_offsets[-1], END_ID, np.int32)
        # pieces go one after another; each row before them has put in one end id
        begin = np.cumsum(size) - size
        spread = np.arange(size.sum())
        out[spread + np.repeat(row, size)] = self.ids[spread + np.repeat(first - begin, size)]
        return out, out_offsets


def pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words, cut between a letter a-z and a full stop or comma."""
    start, end, _ = flat.word_spans(buf, offsets)
    cut = np.flatnonzero(LETTER[buf[:-1]] & STOP[buf[1:]]) + 1
    cut = cut[np.searchsorted(offsets, cut, "right") == np.searchsorted(offsets, cut - 1, "right")]
    start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(offsets, start, "right") - 1


class Pieces:
    """Known pieces by rising hash."""

    def __init__(self, hash: np.ndarray, first: np.ndarray, size: np.ndarray, seen: np.ndarray):
        self.hash, self.first, self.size, self.seen = hash, first, size, seen

    @staticmethod
    def none() -> Pieces:
        return Pieces(np.zeros(0, flat.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.zeros(len(hashes), bool)
        return self.hash[np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)] == hashes

    def take(self, at: np.ndarray) -> Pieces:
        return Pieces(self.hash[at], self.first[at], self.size[at], self.seen[at])

    def merged(self, other: Pieces) -> Pieces:
        at = np.searchsorted(self.hash, other.hash)
        return Pieces(*(np.insert(x, at, y) for x, y in ((self.hash, other.hash), (self.first, other.first),
                                                         (self.size, other.size), (self.seen, other.seen))))


@lru_cache
def encoder(tokenizer: str) -> Encoder:
    """One for each worker process, so that tasks share its cache."""
    return Encoder(tokenizer)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (the end id last) of every row, in the order of the rows."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for b in batches:
            for lo, hi, buf, offsets in flat.chunks(b.column("text")):
                ids, at = coder.encode(buf, offsets)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo),
                                                  pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return docs.mapInArrow(run, schema)


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes the ids of ``docs`` to ORC files under ``path``."""
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    own = own.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    coded = encode(own, tokenizer or default_tokenizer()).select("doc_id", F.monotonically_increasing_id().alias("pos"), "ids")
    (coded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.create.index", "true")
     .option("orc.row.index.stride", str(STRIDE)).option("orc.stripe.size", str(STRIPE)).orc(path))


def read(spark: SparkSession, path: str, doc_type: str = "bigint") -> DataFrame:
    """doc_id, pos, ids; filters on doc_id prune by file, stripe, row index and Bloom filter."""
    return spark.read.schema(f"doc_id {doc_type}, pos long, ids array<int>").orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        at, data = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        raw = memoryview(data).cast("B")
        crc = [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("pos"), pa.array(np.diff(at).astype(np.int64)),
                                          pa.array(crc, pa.int64())], ["doc_id", "pos", "n_tokens", "ids_crc32"])


def digests(files: DataFrame) -> DataFrame:
    """doc_id, pos, n_tokens, ids_crc32 of what ``read`` gives."""
    return files.mapInArrow(_digest, f"doc_id {files.schema['doc_id'].dataType.simpleString()}, pos long, n_tokens long, ids_crc32 long")


def with_start(rows: DataFrame) -> DataFrame:
    """doc_id, start (ids before the row), n_tokens, ids_crc32."""
    rows = rows.withColumn("part", F.shiftright("pos", 33))
    inner = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    rows = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(totals, "part")
    return rows.select("doc_id", F.expr("before + within").alias("start"), "n_tokens", "ids_crc32")


def encode_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes ``docs`` to the session's shared folder and gives the digests of the files read back."""
    run = Run(docs.sparkSession, "tokens")
    write(docs, run.path("orc"), tokenizer)
    files = read(docs.sparkSession, run.path("orc"), docs.schema["doc_id"].dataType.simpleString())
    return with_start(run.save(digests(files), "rows"))
