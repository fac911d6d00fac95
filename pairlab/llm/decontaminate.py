"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased (A-Z), runs of white space become one space, and q-grams are over the UTF-8 bytes.
A benchmark item is looked for whole, or, beyond ``WHOLE`` bytes, in overlapping windows of
``WINDOW`` bytes, so that a long passage is found by any part of it. A window of n bytes may lie
in a document with up to e = ``EDITS`` * n edits (fewer for short windows). By the q-gram
lemma such a region shares at least n - Q + 1 - Q * e q-grams with the window, and these lie on
diagonals (document position less window position) that differ by at most e. Shared q-grams are counted
in bands of diagonals of twice that width, overlapping by half, so one band holds them all. Bands that meet
the bound are verified by banded alignment of the whole window, all of a chunk at once.

The benchmark is the query set: its index is broadcast in blocks of at most ``BLOCK`` bytes of text (an item
that is longer makes its own block), and every block is held against all documents. There is no shuffle of
documents and no limit on matches.

Defined cases. Null or empty documents match nothing. Null items, and items under ``LEAST`` bytes once
normalised, are no evidence and match nothing. Null or repeated ids are kept as they are: one result row for
each (document row, benchmark row) that match. Empty tables: no rows. Other columns are ignored by
``matches`` and passed on by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlab.llm import flat

Q = 10
EDITS = 0.07
WINDOW, WHOLE = 100, 150
LEAST = 16
#: Least number of shared q-grams that the edit budget of a short window must leave.
SHARED = 6
BLOCK = 8_000_000
#: Diagonals that a band moves on; no window has more edits than this less one.
STEP = int(EDITS * WHOLE) + 1


def normalise(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with single spaces and none in front of a row."""
    space = flat.SPACE[buf]
    low = np.where(space, np.uint8(32), flat.LOWER[buf])
    before = np.empty(len(buf), bool)
    before[1:] = space[:-1]
    before[offsets[:-1][offsets[:-1] < len(buf)]] = True
    keep = ~space | ~before
    at = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], at[offsets]


def budget(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits allowed, q-grams that must be shared) for windows of n bytes."""
    e = np.minimum(np.floor(EDITS * n), np.maximum(0, (n - Q + 1 - SHARED) // Q)).astype(np.int64)
    return e, np.maximum(1, n - Q + 1 - Q * e)


class Index:
    """The windows of one block of the benchmark and their sorted q-grams."""

    def __init__(self, texts: list[str | None]):
        data, item, offsets = [], [], [0]
        for i, text in enumerate(texts):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            b = normalise(raw, np.array([0, len(raw)]))[0]
            b = b[:-1] if len(b) and b[-1] == 32 else b
            if len(b) < LEAST:
                continue
            cuts = [0] if len(b) <= WHOLE else [*range(0, len(b) - WINDOW, WINDOW // 2), len(b) - WINDOW]
            for c in cuts:
                w = b if len(b) <= WHOLE else b[c:c + WINDOW]
                data.append(w)
                item.append(i)
                offsets.append(offsets[-1] + len(w))
        self.bytes = np.concatenate(data) if data else np.zeros(0, np.uint8)
        self.offsets, self.item = np.array(offsets), np.array(item, np.int64)
        size = np.diff(self.offsets)
        self.edits, self.need = budget(size)
        window = np.repeat(np.arange(len(size)), np.maximum(size - Q + 1, 0))
        first = np.cumsum(np.maximum(size - Q + 1, 0)) - np.maximum(size - Q + 1, 0)
        place = np.arange(len(window)) - first[window] if len(size) else window
        start = self.offsets[window] + place
        gram = flat.span_hash(flat.prefix(self.bytes), start, start + Q)
        order = np.argsort(gram, kind="stable")
        self.gram, first = np.unique(gram[order], return_index=True)
        self.run = np.append(first, len(gram))
        self.window, self.place = window[order], place[order]
        bits = max(16, int(32 * len(self.gram)).bit_length())
        self.mask = flat.U64((1 << bits) - 1)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.gram & self.mask).astype(np.int64)] = True

    def hits(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document position, window, position in it) of every shared q-gram."""
        start = np.arange(max(0, len(buf) - Q + 1))
        gram = flat.span_hash(flat.prefix(buf), start, start + Q)
        at = np.flatnonzero(self.filter[(gram & self.mask).astype(np.int64)])
        row = np.searchsorted(offsets, at, "right") - 1
        at = at[at + Q <= offsets[row + 1]]
        which = np.minimum(np.searchsorted(self.gram, gram[at]), len(self.gram) - 1)
        same = self.gram[which] == gram[at]
        at, which = at[same], which[same]
        n = self.run[which + 1] - self.run[which]
        posting = np.arange(n.sum()) + np.repeat(self.run[which] - (np.cumsum(n) - n), n)
        return np.repeat(at, n), self.window[posting], self.place[posting]

    def regions(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, window, first diagonal) of the bands whose shared q-grams meet the bound."""
        at, window, place = self.hits(buf, offsets)
        row = np.searchsorted(offsets, at, "right") - 1
        band = (at - place) // STEP
        # a hit lies in the band that starts at its own step and in the one before
        rows = np.concatenate([row, row])
        key = np.stack([rows, np.concatenate([window, window]), np.concatenate([band, band - 1]), np.concatenate([place, place])])
        key = key[:, np.lexsort(key[::-1])]
        if not key.shape[1]:
            return key[0], key[1], key[2]
        fresh = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))  # a q-gram of the window counts once
        key = key[:3, fresh]
        first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        count = np.diff(np.append(first, key.shape[1]))
        first = first[count >= self.need[key[1, first]]]
        return key[0, first], key[1, first], key[2, first] * STEP

    def align(self, buf: np.ndarray, offsets: np.ndarray, row: np.ndarray, window: np.ndarray,
              diagonal: np.ndarray) -> np.ndarray:
        """Least edits between each window and any part of its row within the band, widened by the budget."""
        size = self.offsets[window + 1] - self.offsets[window]
        k = 2 * STEP + 2 * STEP
        shift = diagonal[:, None] - STEP + np.arange(k)[None, :]
        lo, hi = offsets[row][:, None], offsets[row + 1][:, None]
        ramp = np.arange(k, dtype=np.int32)
        far = np.int32(1 << 20)
        # a start in front of the row's first byte would be no part of the row
        cost = np.where((shift >= lo) & (shift <= hi), 0, far).astype(np.int32)
        best = np.full(len(row), far, np.int32)
        for i in range(int(size.max(initial=0))):
            live = i < size
            w = self.bytes[np.minimum(self.offsets[window] + i, len(self.bytes) - 1)]
            at = shift + i
            inside = (at >= lo) & (at < hi)
            same = inside & (buf[np.clip(at, 0, len(buf) - 1)] == w[:, None])
            step = cost + np.where(same, 0, np.where(inside, 1, far)).astype(np.int32)
            skip = np.full_like(cost, far)
            skip[:, :-1] = cost[:, 1:] + 1
            new = np.minimum(step, skip)
            new = np.minimum(np.minimum.accumulate(new - ramp, axis=1) + ramp, far)
            cost = np.where(live[:, None], new, cost)
            ended = i == size - 1
            best[ended] = cost[ended].min(axis=1)
        return best

    def found(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, window, edits) of the verified windows."""
        buf, offsets = normalise(buf, offsets)
        if not len(buf) or not len(self.gram):
            none = np.zeros(0, np.int64)
            return none, none, none
        row, window, diagonal = self.regions(buf, offsets)
        parts = [self.align(buf, offsets, row[i:i + 4096], window[i:i + 4096], diagonal[i:i + 4096])
                 for i in range(0, len(row), 4096)]
        edits = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        good = edits <= self.edits[window]
        return row[good], window[good], edits[good]


def blocks(benchmark: DataFrame) -> list[DataFrame]:
    """(item_id, text) in parts whose texts have about BLOCK bytes at most."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // (BLOCK // 2)) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [items.filter(part == i) for i in range(n)] if n > 1 else [items]


def _index(spark, block: DataFrame):
    rows = block.collect()
    return spark.sparkContext.broadcast(([r["item_id"] for r in rows], Index([r["text"] for r in rows])))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, windows of the item, windows found in the document, least edits of one."""
    spark = docs.sparkSession
    ids = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {ids[0]}, item_id {ids[1]}, n_windows long, n_found long, edits long"
    kind = pa.int64() if ids[1] in ("bigint", "long") else pa.int32() if ids[1] == "int" else pa.string()

    def part(block: DataFrame) -> DataFrame:
        shared = _index(spark, block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, index = shared.value
            names, of = pa.array(names, kind), np.bincount(index.item, minlength=len(names))
            for b in batches:
                for lo, hi, buf, offsets in flat.chunks(b.column("text")):
                    row, window, edits = index.found(buf, offsets)
                    if not len(row):
                        continue
                    hit = np.unique(np.stack([row, index.item[window], window]), axis=1, return_inverse=True)
                    least = np.full(hit[0].shape[1], 1 << 30)
                    np.minimum.at(least, hit[1].ravel(), edits)
                    pair, which, n = np.unique(hit[0][:2], axis=1, return_inverse=True, return_counts=True)
                    low = np.full(pair.shape[1], 1 << 30)
                    np.minimum.at(low, which.ravel(), least)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array(pair[0] + lo)), names.take(pa.array(pair[1])),
                         pa.array(of[pair[1]].astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(low.astype(np.int64))],
                        ["doc_id", "item_id", "n_windows", "n_found", "edits"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [part(b) for b in blocks(benchmark)])


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    spark = docs.sparkSession
    for block in blocks(benchmark):
        shared = _index(spark, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value[1]
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for lo, _, buf, offsets in flat.chunks(b.column("text")):
                    clean[lo + index.found(buf, offsets)[0]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
