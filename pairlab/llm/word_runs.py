"""Periodic runs of words, found on a Re-Pair grammar of each text.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least
``MIN_LENGTH`` words and ``MIN_EXPONENT`` periods that no neighbouring word extends keeping period q.

1. Grammar. The word ids of a text are paired as in Re-Pair: a pair of neighbouring symbols that occurs
   twice or more without overlap becomes a nonterminal. A round replaces every pair that is more frequent
   than the pairs overlapping it, for all texts of a chunk at once, until no pair repeats. The rest of a
   text is closed by a balanced tree of nonterminals that occur once.
2. Runs of a nonterminal X -> YZ. A run that crosses the boundary of Y and Z has two periods at least
   on one side of it; every period that passes the comparison of those two is extended to both sides
   inside X. This is done once for a nonterminal, however often it is derived.
3. A run of the text lies whole inside the smallest derivation node that holds it, and crosses that
   node's boundary. So the runs of each nonterminal are moved to all its derivation positions, and
   intervals of one period that overlap by a period or more are merged: the maximal ones remain.

Work grows as n log n with the words of a text. Texts are handled in Arrow batches on the executors,
nothing is shuffled; one text must fit some forty times into a worker's memory.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; every input row
gives one row, repeated rows and null ids included. Columns other than those named are not read. Words
are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm import flat

MIN_LENGTH = 6
MIN_EXPONENT = 4
WORD = r"[^\x20\x09-\x0D]+"
#: (node, period) pairs that are looked at together.
BLOCK = 1 << 21
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_ARROW_RUN = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


class _Words:
    """Words of a chunk with prefix sums of their hashes, to compare stretches of words."""

    def __init__(self, hashes: np.ndarray):
        self.w = hashes
        self.power = flat._power("up", len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.power[:len(hashes)], out=self.sums[1:])

    def same(self, at: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from ``at`` equal those q further on."""
        s = self.sums
        return (s[at + n] - s[at]) * self.power[q] == s[at + q + n] - s[at + q]

    def reach(self, at: np.ndarray, q: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """How many words after (or before) ``at`` equal those q further on, up to ``most``."""
        low, high = np.zeros(len(at), np.int64), most.astype(np.int64)
        open_ = np.flatnonzero(high > low)
        while len(open_):
            mid = (low[open_] + high[open_] + 1) >> 1
            begin = at[open_] if forward else at[open_] - mid
            ok = self.same(begin, q[open_], mid)
            low[open_[ok]] = mid[ok]
            high[open_[~ok]] = mid[~ok] - 1
            open_ = open_[high[open_] > low[open_]]
        return low


def _periods(most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, q) for q = 1 .. most[node], in blocks of about ``BLOCK`` pairs."""
    total = np.concatenate([[0], np.cumsum(most)])
    lo = 0
    while lo < len(most):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + BLOCK, "right")) - 1)
        n = most[lo:hi]
        if total[hi] > total[lo]:
            node = np.repeat(np.arange(lo, hi), n)
            yield node, np.arange(total[lo], total[hi]) - total[node] + 1
        lo = hi


def _crossing(words: _Words, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the runs inside lo..hi that cross mid."""
    w, found = words.w, []
    whole = (hi - lo) // MIN_EXPONENT
    whole[hi - lo < MIN_LENGTH] = 0
    for right in (True, False):
        room = (hi - mid if right else mid - lo) // 2
        for node, q in _periods(np.minimum(room, whole)):
            b = mid[node]
            first = b if right else b - q  # two periods stand side by side from here, or end q after it
            left = first if right else b - 2 * q
            ok = (w[left] == w[left + q]) & (w[left + q - 1] == w[left + 2 * q - 1])
            node, q, first, left = node[ok], q[ok], first[ok], left[ok]
            ok = words.same(left, q, q)
            node, q, first = node[ok], q[ok], first[ok]
            start = first - words.reach(first, q, first - lo[node], False)
            end = first + q + words.reach(first, q, hi[node] - first - q, True)
            ok = end - start >= np.maximum(MIN_LENGTH, MIN_EXPONENT * q)
            found.append((node[ok], start[ok], end[ok], q[ok]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    node, start, end, q = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((q, end, start, node))
    node, start, end, q = node[by], start[by], end[by], q[by]
    least = np.ones(len(node), bool)  # of the periods of one stretch the smallest is its period
    least[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[least], start[least], end[least], q[least]


def _repeated(sym: np.ndarray, row: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs to replace in this round: (place, number of the pair), and the pairs that stay repeated."""
    at = np.flatnonzero(open_[:-1] & (row[1:] == row[:-1]))
    key = sym[at] * (sym.max() + 1) + sym[at + 1]
    idx = np.arange(len(at))
    link = np.zeros(len(at), bool)
    link[1:] = (key[1:] == key[:-1]) & (at[1:] == at[:-1] + 1)
    even = (idx - np.maximum.accumulate(np.where(link, 0, idx))) % 2 == 0  # a a a: every other pair
    at, key = at[even], key[even]
    _, number, count = np.unique(key, return_inverse=True, return_counts=True)
    many = count[number] >= 2
    at, key, number = at[many], key[many], number[many]
    if not len(at):
        return at, number, at
    rank = np.zeros(len(sym) + 2, np.int64)
    rank[at + 1] = (np.minimum(count[number], 1 << 20) << 40) | (flat.mix(key.astype(np.uint64)) >> np.uint64(24)).astype(np.int64)
    chosen = (rank[at + 1] > rank[at]) & (rank[at + 1] >= rank[at + 2])
    chosen[chosen] = np.bincount(number[chosen], minlength=len(count))[number[chosen]] >= 2
    return at[chosen], number[chosen], at[~chosen]


def runs_of(hashes: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and then period; words are counted over the chunk."""
    n = len(hashes)
    words = _Words(hashes)
    _, sym = np.unique(flat.mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)
    sym = sym.astype(np.int64)
    fresh = len(sym) + 1
    start, row = np.arange(n), row.copy()
    open_ = np.bincount(sym)[sym] >= 2 if n else np.zeros(0, bool)
    open_[:-1] &= open_[1:]
    starts, ends, periods = [], [], []

    def take(lo, mid, hi, place, of):
        """Runs of the nodes, moved to every place where node ``of`` is derived."""
        node, s, e, q = _crossing(words, lo, mid, hi)
        if not len(node):
            return
        if place is None:
            starts.append(s), ends.append(e), periods.append(q)
            return
        by = np.argsort(of, kind="stable")
        place, of = place[by], of[by]
        first = np.searchsorted(of, node)
        copies = np.searchsorted(of, node, "right") - first
        which = np.repeat(np.arange(len(node)), copies)
        at = place[np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies) + np.repeat(first, copies)]
        shift = at - lo[node][which]
        starts.append(s[which] + shift), ends.append(e[which] + shift), periods.append(q[which])

    while len(sym) > 1:
        at, number, rest = _repeated(sym, row, open_)
        if not len(at):
            break
        bound = np.append(start, n)
        kinds, first, of = np.unique(number, return_index=True, return_inverse=True)
        model = at[first]
        take(bound[model], bound[model + 1], bound[model + 2], bound[at], of)
        sym[at] = fresh + of
        fresh += len(kinds)
        open_[:] = False
        open_[rest] = True
        open_[at + 1] = True
        open_[at[at > 0] - 1] = True
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        open_[at] = open_[at + 1]
        sym, start, row, open_ = sym[stay], start[stay], row[stay], open_[stay]

    size = np.bincount(row, minlength=n_rows)
    bound_of_row = np.append(start, n)[np.cumsum(size)]  # end of each row in words
    while size.max(initial=0) > 1:
        busy = size[row] > 1
        start, row = start[busy], row[busy]
        size[size == 1] = 0
        offset = np.arange(len(start)) - (np.cumsum(size) - size)[row]
        left = np.flatnonzero((offset % 2 == 0) & (offset + 1 < size[row]))
        last = left + 2 >= len(start)
        after = np.where(last, 0, start[np.minimum(left + 2, len(start) - 1)])
        inner = ~last & (row[np.minimum(left + 2, len(start) - 1)] == row[left])
        take(start[left], start[left + 1], np.where(inner, after, bound_of_row[row[left]]), None, None)
        stay = offset % 2 == 0
        start, row = start[stay], row[stay]
        size = np.bincount(row, minlength=n_rows)
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    return _maximal(np.concatenate(starts), np.concatenate(ends), np.concatenate(periods))


def _maximal(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that overlap by it or more become one."""
    by = np.lexsort((s, q))
    s, e, q = s[by], e[by], q[by]
    group = np.cumsum(np.concatenate([[0], q[1:] != q[:-1]])) * (int(e.max()) + 1)
    far = np.maximum.accumulate(group + e) - group
    new = np.ones(len(s), bool)
    new[1:] = (q[1:] != q[:-1]) | (s[1:] > far[:-1] - q[1:])
    begin = np.flatnonzero(new)
    s, e, q = s[begin], far[np.append(begin[1:], len(far)) - 1], q[begin]
    by = np.lexsort((q, s))
    return s[by], e[by], q[by]


def _chunk(buf: np.ndarray, offsets: np.ndarray, n_rows: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(words, runs, collapsed text) of every row."""
    begin, end, row = flat.word_spans(buf, offsets)
    count = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    first = np.cumsum(count) - count
    s, e, q = runs_of(flat.span_hash(flat.prefix(buf), begin, end), row, n_rows)
    run_row = row[s] if len(s) else np.zeros(0, np.int64)
    bounds = np.searchsorted(run_row, np.arange(n_rows + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(
        [pa.array(x.astype(np.int64)) for x in (s - first[run_row], e - s, q)], names=["start", "length", "period"]))
    change = np.zeros(len(begin) + 1, np.int64)
    np.add.at(change, s + q, 1)
    np.add.at(change, e, -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    begin, end, row = begin[kept], end[kept], row[kept]
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    size = end - begin + ~last  # a space follows every word but the last of a text
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = buf[np.minimum(np.arange(at[-1]) + np.repeat(begin - at[:-1], size), max(len(buf) - 1, 0))]
    data[at[1:][~last] - 1] = 0x20
    ends = at[np.searchsorted(row, np.arange(n_rows + 1))]
    texts = pa.LargeStringArray.from_buffers(n_rows, pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())
    return count, runs, texts


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (start, length, period by start and then period), collapsed: the text without
    the words that a run holds after its first period, joined by one space."""
    out = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()),
                        T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in flat.chunks(batch.column(1)):
                count, runs, texts = _chunk(buf, offsets, hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(count.astype(np.int64)), runs.cast(_ARROW_RUN), texts],
                                                 names=["key", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, out).withColumnRenamed("key", key)


def with_tail(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) where a tenth of the texts, by the checksum of the key, end in a periodic tail.

    With h = crc32 of the decimal key and g = floor(h / 10): where h % 10 = 0, word i >= a = g % n becomes word
    a + (i - a) % p of the n words, p = 1 + floor((n - a) / (3 + g % 8)). A null key changes nothing.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda x: F.array_join(F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: w[F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"])]), " "))[0]

    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    damaged = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)))[0]
    return docs.select(F.col(key), F.when(h % 10 == 0, damaged).otherwise(F.col(text)).alias(text))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of figures and checksums for each row of ``find``.

    The float quotient of a run orders exactly: lengths stay far under 2^26 words.
    """
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("x"), (-r["start"]).alias("s"), (-r["period"]).alias("p"),
                                                              r["length"].alias("n"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[n].cast("string") for n in RUN.names]), F.lit("\n"))), "")
    return (found.withColumn("best", best)
            .select(key, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
                    (-F.col("best.p")).alias("period"),
                    F.floor(1000 * F.col("best.n") / -F.col("best.p")).cast("long").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
                    F.col("n_words")))
