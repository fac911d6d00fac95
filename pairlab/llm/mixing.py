"""Mixing sources to target weights by a low-discrepancy source schedule.

Targets: sources ranked by code point (null last) weigh 5, 2, 1, repeating, and share the words of all documents;
no target passes ``MOST`` times its source's size, and what is cut off is shared again by weight.

Schedule: slot k has the point frac((k + 1) / golden ratio), kept as a 64-bit integer, and belongs to the source in
whose stretch of the cumulative weights the point falls. The slots of a source are ranked, and rank r takes block
r modulo the source's number of blocks. A source's documents are shuffled by a hash, laid end to end and cut into
blocks of equal words (the last may be shorter). A source's slots end at its quota; the few that the sequence still
owes it when it ends follow as make-up slots.

Scale: slots are generated in chunks by Spark tasks; ranks come from counts by (chunk, source) and a
running sum over chunks. Positions in a source come from running sums within hash buckets and over bucket totals, so
neither slots nor documents of a hot source meet in one task. The driver holds one row for each source.

Defined cases. Null or empty text: size 0, taken 0. Null source: a source of its own, last. Sources without a word:
target 0. Repeated rows are separate rows. No document at all: no rows. Other columns are ignored by ``taken`` and
passed on by ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.llm import flat
from pairlab.llm.scratch import Run

WEIGHTS = (5, 2, 1)
MOST = 3
#: Most words in a block; a small source has blocks of a FINE-th of its size, so that it comes near its target.
BLOCK, FINE = 1024, 256
#: Slots that one row of the generator makes.
CHUNK = 1 << 16
#: Documents in a hash bucket of a source, about.
BUCKET = 20_000
#: Two to the 64 over the golden ratio.
GOLDEN = 11400714819323198485
KEY = "_mix_key"


def targets(sizes: list[int]) -> list[float]:
    """Target words of each source, in the order of the ranks."""
    weight = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] / total > MOST * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = float(MOST * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def geometry(size: int, target: float) -> tuple[int, int, int]:
    """(words in a block, blocks, slots) of a source."""
    block = max(1, min(BLOCK, size // FINE))
    blocks = -(-size // block)
    if not size:
        return block, 0, 0
    whole, rest = divmod(target, size)
    return block, blocks, int(whole) * blocks + min(blocks, round(rest / block))


def _sizes(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", "source", F.xxhash64("text", "lang", "source").alias(KEY), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, {KEY} long, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.bincount(flat.word_spans(buf, at)[2], minlength=hi - lo) for lo, hi, buf, at in flat.chunks(b.column("text"))]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "source", KEY)] + [pa.array(n.astype(np.int64))],
                                             ["doc_id", "source", KEY, "size"])

    return own.mapInArrow(run, schema)


def sources(sizes: DataFrame) -> pd.DataFrame:
    """One row for each source, by rank: source, size, docs, target, block, blocks, slots."""
    rows = [r.asDict() for r in sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()]
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    for i, (r, t) in enumerate(zip(rows, targets([r["size"] for r in rows]), strict=True)):
        r["target"], r["rank"] = t, i
        r["block"], r["blocks"], r["slots"] = geometry(r["size"], t)
    return pd.DataFrame(rows, columns=["rank", "source", "size", "docs", "target", "block", "blocks", "slots"])


def _stretches(slots: np.ndarray) -> np.ndarray:
    """Ends of the sources' stretches of the 64-bit circle, all but the last."""
    total, run, ends = int(slots.sum()), 0, []
    for n in slots[:-1]:
        run += int(n)
        ends.append(min((run << 64) // max(total, 1), (1 << 64) - 1))
    return np.array(ends, np.uint64)


def _slots(chunk: int, total: int, ends: np.ndarray) -> np.ndarray:
    """The source of each slot of a chunk."""
    k = np.arange(chunk * CHUNK, min((chunk + 1) * CHUNK, total), dtype=np.uint64)
    return np.searchsorted(ends, (k + np.uint64(1)) * np.uint64(GOLDEN), "right")


def schedule(spark: SparkSession, plan: pd.DataFrame) -> DataFrame:
    """slot, source rank, block, pass: the mix in order."""
    slots = plan["slots"].to_numpy(np.int64)
    total, ends = int(slots.sum()), _stretches(slots)
    n = -(-total // CHUNK)
    s = len(slots)

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c in f["id"]:
                have = np.bincount(_slots(c, total, ends), minlength=s)
                yield pd.DataFrame({"chunk": c, "rank": np.flatnonzero(have), "n": have[have > 0]})

    spread = spark.range(0, n, 1, max(1, min(n, spark.sparkContext.defaultParallelism * 4)))
    held = spread.mapInPandas(counts, "chunk long, rank int, n long")
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = held.groupBy("chunk").agg(F.collect_list(F.struct("rank", "before")).alias("starts"))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c, have in zip(f["chunk"], f["starts"], strict=True):
                first = np.zeros(s, np.int64)
                for x in have:
                    first[x["rank"]] = x["before"]
                of = _slots(c, total, ends)
                order = np.argsort(of, kind="stable")
                begin = np.searchsorted(of[order], np.arange(s))
                turn = np.empty(len(of), np.int64)
                turn[order] = np.arange(len(of)) - begin[of[order]]
                yield pd.DataFrame({"slot": c * CHUNK + np.arange(len(of)), "rank": of, "turn": first[of] + turn})

    made = starts.mapInPandas(rows, "slot long, rank int, turn long")
    quota = spark.createDataFrame([(int(r["rank"]), int(r["slots"]), int(r["blocks"])) for r in plan.to_dict("records")],
                                  "rank int, slots long, blocks long")
    given = quota.join(held.groupBy("rank").agg(F.sum("n").alias("given")), "rank", "left").fillna(0, ["given"])
    owed = given.filter("given < slots").select(
        F.lit(total).cast("long").alias("slot"), "rank", F.explode(F.sequence("given", F.col("slots") - 1)).alias("turn"))
    out = made.unionByName(owed).join(quota, "rank").filter("turn < slots")
    return out.select("slot", "rank", F.expr("turn % blocks").alias("block"), F.expr("turn div blocks").alias("pass"))


def _placed(docs: DataFrame, run: Run) -> tuple[DataFrame, pd.DataFrame]:
    """(rows with their source's figures and first word in the source's shuffled order, the sources)."""
    spark = docs.sparkSession
    sizes = run.save(_sizes(docs), "sizes")
    plan = sources(sizes)
    table = spark.createDataFrame([(int(r["rank"]), r["source"], int(r["size"]), float(r["target"]), int(r["block"]))
                                   for r in plan.to_dict("records")],
                                  "rank int, s_source string, source_size long, target double, block_words long")
    rows = sizes.join(table, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    buckets = max(1, int(plan["docs"].sum()) // BUCKET) if len(plan) else 1
    h = F.xxhash64(F.lit("mix"), "doc_id", KEY)
    rows = rows.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    inner = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", KEY, "size").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    totals = totals.select("rank", "bucket", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("offset"))
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(totals, ["rank", "bucket"])
    return rows.withColumn("start", F.col("offset") + F.col("within")).drop("offset", "within", "h", "bucket"), plan


def _uses(spark: SparkSession, plan: pd.DataFrame) -> DataFrame:
    return schedule(spark, plan).groupBy("rank", "block").agg(F.count("*").alias("uses"))


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    run = Run(docs.sparkSession, "mix")
    placed, plan = _placed(docs, run)
    rows = run.save(placed, "placed")
    uses = run.save(_uses(docs.sparkSession, plan), "uses")
    own = ["doc_id", "size", "source_size", "target", "rank", "start", KEY]
    pieces = rows.filter("size > 0").select(*own, "block_words", F.explode(F.sequence(
        F.expr("start div block_words"), F.expr("(start + size - 1) div block_words"))).alias("block"))
    words = F.least(F.expr("start + size"), F.expr("(block + 1) * block_words")) - F.greatest("start", F.expr("block * block_words"))
    out = pieces.withColumn("words", words).join(uses, ["rank", "block"], "left")
    out = out.groupBy(*own).agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"))
    none = rows.filter("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return out.select(*none.columns).unionByName(none)


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the schedule takes the block that holds its first word: 0 to MOST times."""
    run = Run(docs.sparkSession, "mix")
    placed, plan = _placed(docs, run)
    uses = _uses(docs.sparkSession, plan)
    rows = placed.filter("size > 0").withColumn("block", F.expr("start div block_words")).join(uses, ["rank", "block"])
    times = run.save(rows.groupBy(F.col("doc_id").alias("_mix_id"), F.col(KEY).alias("_mix_text")).agg(F.sum("uses").alias("_mix_uses")), "times")
    key = F.xxhash64("text", "lang", "source")
    marked = docs.withColumn(KEY, key).dropDuplicates(["doc_id", KEY])
    out = marked.join(times, F.col("doc_id").eqNullSafe(F.col("_mix_id")) & (F.col(KEY) == F.col("_mix_text")))
    out = out.withColumn("_mix_turn", F.explode(F.sequence(F.lit(1), F.col("_mix_uses").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
