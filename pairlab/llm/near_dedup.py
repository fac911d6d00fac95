"""MinHash near-dedup with ProbMinHash signatures, banding and exact verification.

A text is the weighted set of its 5-word shingles, weighted by how often each occurs. Every shingle
owns a Poisson process whose rate is its weight: its k-th arrival time and the register it falls
into are hashes of (shingle, k). A register keeps the shingle that arrived first, so two texts
agree in a register with their probability Jaccard similarity. Shingles are
advanced one arrival at a time, all rows of a chunk together, and a shingle drops out as soon as its
arrival is later than every register of its row (early termination).

A text with a shingle that occurs twice or more has a second signature, of its shingle set (all weights 1); for
any other text the two are the same. Keys of both kinds share the buckets, so pairs that only plain Jaccard
links meet as well.

``BANDS`` bands of ``ROWS`` registers make buckets. No pairs of a bucket are formed as rows but those with its centre:

1. every member is compared with one centre, the least of the bucket;
2. verified links are joined to components;
3. a bucket whose members lie in several components is open. Its members outside the largest component
   are compared with all members of other components, a block of ``BLOCK`` bytes against a block, inside a
   task. Only links that join two components leave it. A pair that shares several buckets is
   compared in the first of them.

Two members of one component need no comparison, so each bucket ends with the components that all its
pairs would give, whatever its size. Pairs with a centre pass an estimate from the signatures (``ESTIMATE``,
over five standard deviations below the threshold, by the weighted signatures or by those of the sets); all links hold by the exact measure on whole
texts: probability Jaccard, or plain Jaccard of the shingle sets, of at least ``THRESHOLD``. Texts at
the threshold share a bucket with probability 0.9999.

Defined cases. Equal texts are one class whatever their length; a text under five words has one shingle
of all its words; an empty text, or one of white space only, is alike only to equal texts; a null text
is a class of its own with every other null text only if the ids are equal too. class_id is the least
doc_id of the class (null if all are null). Repeated rows get one result row each. Empty
input: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm import flat
from pairlab.llm.scratch import Run

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
ESTIMATE = 0.6
#: Bytes of texts, with as many for each text besides as OVERHEAD, that one side of a block comparison holds.
BLOCK, OVERHEAD = 1 << 20, 1 << 10
#: Words of 64 bits in the filter that keeps texts which no comparison needs out of the shuffle.
FILTER = 1 << 18


def weighted_shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of every distinct shingle; short texts have one, empty ones none."""
    start, end, row = flat.word_spans(buf, offsets)
    words = flat.span_hash(flat.prefix(buf), start, end)
    grams, at = flat.shingles(words, row, WORDS)
    of = row[at]
    n = np.bincount(row, minlength=len(offsets) - 1)
    few = np.flatnonzero((n > 0) & (n < WORDS))
    if len(few):
        first = np.concatenate([[0], np.cumsum(n)])[few]
        whole = np.zeros(len(few), flat.U64)
        for j in range(WORDS - 1):
            has = n[few] > j
            whole[has] = flat.mix(whole[has] + words[first[has] + j] + flat.U64(j + 1))
        grams, of = np.concatenate([grams, whole]), np.concatenate([of, few])
    _, index, count = np.unique(flat.mix(grams ^ flat.mix(of.astype(flat.U64))), return_index=True, return_counts=True)
    return of[index], grams[index], count


def signatures(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x REGISTERS of shingle hashes, whether the row has any)."""
    return _registers(len(offsets) - 1, *weighted_shingles(buf, offsets))


def set_signatures(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, whether the row has any shingle, rows with a repeated shingle, signatures of their shingle sets)."""
    n = len(offsets) - 1
    row, gram, weight = weighted_shingles(buf, offsets)
    sig, has = _registers(n, row, gram, weight)
    heavy = np.bincount(row, weight > 1, n) > 0
    some = heavy[row]
    plain, _ = _registers(int(heavy.sum()), (np.cumsum(heavy) - 1)[row[some]], gram[some], np.ones(int(some.sum())))
    return sig, has, heavy, plain


def _registers(n: int, row: np.ndarray, gram: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x REGISTERS of shingle hashes, whether the row has any) from (row, hash, weight) of shingles."""
    first = np.full(n * REGISTERS, np.inf)
    out = np.zeros(n * REGISTERS, flat.U64)
    time = np.zeros(len(gram))
    k = 0
    while len(gram):
        k += 1
        h = flat.mix(gram + flat.U64(k * 0xA0761D6478BD642F % (1 << 64)))
        time = time - np.log(flat.unit(h)) / weight
        at = row * REGISTERS + (flat.mix(h) % flat.U64(REGISTERS)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = time == first[at]
        out[at[won]] = gram[won]
        live = time < first.reshape(n, REGISTERS).max(axis=1)[row]
        row, gram, weight, time = row[live], gram[live], weight[live], time[live]
    has = np.isfinite(first.reshape(n, REGISTERS)[:, 0]) if n else np.zeros(0, bool)
    return out.reshape(n, REGISTERS), has


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One bucket key for each row and band."""
    keys = np.zeros((len(sig), BANDS), flat.U64)
    for j in range(ROWS):
        keys = flat.mix(keys * flat.U64(3) + sig[:, j::ROWS])
    return flat.mix(keys ^ flat.mix(np.arange(BANDS, dtype=flat.U64))).astype(np.int64)


def _rows(has: np.ndarray, heavy: np.ndarray, own: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of rows that hold a row of ``own`` where ``has``, and then one of ``plain`` where ``heavy``."""
    width = own.shape[1]
    at = np.concatenate([[0], np.cumsum(width * (has.astype(np.int64) + heavy))]).astype(np.int32)
    out = np.zeros(at[-1], own.dtype)
    step = np.arange(width)
    out[at[:-1][has][:, None] + step] = own
    out[at[1:][heavy][:, None] - width + step] = plain
    return at, out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest and bytes of the text, band keys (none for empty texts), 16 bits of every register.

    Rows with a repeated shingle have the keys and registers of the weighted signature, then those of the set.
    """
    own = docs.select("doc_id", digest("text").alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, bytes int, bands array<long>, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offsets in flat.chunks(b.column("text")):
                sig, has, heavy, plain = set_signatures(buf, offsets)
                at, keys = _rows(has, heavy, band_keys(sig[has]), band_keys(plain))
                bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys))
                size, low = _rows(np.ones(hi - lo, bool), heavy, sig.astype(np.uint16), plain.astype(np.uint16))
                bits = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(2 * size), pa.py_buffer(low)])
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest").cast(pa.binary()), part.column("bytes"),
                                                  bands, bits], ["doc_id", "digest", "bytes", "bands", "sig"])

    return own.mapInArrow(run, schema)


def digest(text: str, doc_id: str = "doc_id") -> Column:
    """128 bits that stand for a text; a null text stands for itself and its id."""
    return F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), F.col(text)),
                                    F.concat(F.lit("n"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))))


def similarities(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Exact (probability Jaccard, Jaccard) of the weighted shingles of a[i] and b[i]."""
    def side(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, _, buf, offsets = next(flat.chunks(x, 1 << 62))
        return weighted_shingles(buf, offsets)

    n = len(a)
    (ra, ga, wa), (rb, gb, wb) = side(a), side(b)
    rows = np.concatenate([ra, rb])
    _, index, which = np.unique(flat.mix(np.concatenate([ga, gb]) ^ flat.mix(rows.astype(flat.U64))),
                                return_index=True, return_inverse=True)
    x, y, row = np.zeros(len(index)), np.zeros(len(index)), rows[index]
    x[which[:len(ra)]], y[which[len(ra):]] = wa, wb
    both = (x > 0) & (y > 0)
    plain = np.bincount(row, both, n) / np.maximum(np.bincount(row, minlength=n), 1)
    # sum over shared i of 1 / sum_j max(x_j / x_i, y_j / y_i): by rising x/y, those before i count y, the others x
    with np.errstate(divide="ignore"):
        order = np.lexsort((np.where(y > 0, x / np.where(y > 0, y, 1), np.inf), row))
    x, y, row, both = x[order], y[order], row[order], both[order]
    begin = np.searchsorted(row, np.arange(n + 1))
    sx, sy = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    i = np.flatnonzero(both)
    r = row[i]
    total = (sx[begin[r + 1]] - sx[i]) / x[i] + (sy[i] - sy[begin[r]]) / y[i]
    return np.bincount(r, 1 / total, n), plain


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = b.column("text_a"), b.column("text_b")
        ends = np.cumsum(pc.add(pc.binary_length(x), pc.binary_length(y)).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(ends):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + flat.CHUNK_BYTES, "right")))
            prob, plain = similarities(x.slice(lo, hi - lo), y.slice(lo, hi - lo))
            good = pa.array(np.maximum(prob, plain) >= THRESHOLD)
            part = b.slice(lo, hi - lo).filter(good)
            yield pa.RecordBatch.from_arrays([part.column("a").cast(pa.binary()), part.column("b").cast(pa.binary())], ["a", "b"])
            lo = hi


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose signatures, weighted or of the sets, agree in a share of ESTIMATE or more of the registers."""
    size = 2 * REGISTERS
    for b in batches:
        x, y = (b.column(c).to_pylist() for c in ("sig_a", "sig_b"))
        share = np.zeros(b.num_rows)
        for part in (slice(0, size), slice(-size, None)):  # the same registers where a row has one signature
            p, q = (np.frombuffer(b"".join(s[part] for s in side), np.uint16).reshape(-1, REGISTERS) for side in (x, y))
            share = np.maximum(share, (p == q).mean(axis=1))
        part = b.filter(pa.array(share >= ESTIMATE))
        yield pa.RecordBatch.from_arrays([part.column("a").cast(pa.binary()), part.column("b").cast(pa.binary())], ["a", "b"])


def _sides(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Joins ``column`` of both members to (a, b)."""
    for side in ("a", "b"):
        pairs = pairs.join(values.select(F.col("digest").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def texts_of(docs: DataFrame, need: DataFrame) -> DataFrame:
    """digest and text of the digests in ``need``, once each.

    A bitmap of FILTER words, broadcast, first keeps nearly all other texts out of the shuffle.
    """
    bit = lambda: F.xxhash64("digest")
    word = lambda: F.pmod(F.shiftright(bit(), 6), F.lit(FILTER)).alias("_word")
    mask = lambda: F.expr("shiftleft(1L, cast(xxhash64(digest) & 63 as int))")
    bits = need.select(word(), mask().alias("m")).groupBy("_word").agg(F.bit_or("m").alias("_bits"))
    own = docs.select(digest("text").alias("digest"), "text").withColumn("_word", word())
    own = own.join(F.broadcast(bits), "_word").filter(F.col("_bits").bitwiseAND(mask()) != 0)
    # an inner join: the optimizer would push a semi join below the filter
    return own.select("digest", "text").join(need, "digest").dropDuplicates(["digest"])


def verify(pairs: DataFrame, texts: DataFrame, docs: DataFrame, run: Run) -> DataFrame:
    """The pairs (a, b) of digests whose texts are near duplicates."""
    likely = run.save(_sides(pairs, texts.select("digest", "sig"), "sig").mapInArrow(_alike, "a binary, b binary"), "likely")
    whole = texts_of(docs, likely.select(F.explode(F.array("a", "b")).alias("digest")).distinct())
    return run.save(_sides(likely, whole, "text").mapInArrow(_verify, "a binary, b binary"), "links")


def merge(label: DataFrame, links: DataFrame, run: Run, name: str) -> DataFrame:
    """(digest, label) after joining the components that the links connect; the least label stays.

    Works on the graph of labels. Every round takes the least label around each node and then follows labels
    one step, until both ends of every link agree.
    """
    ends = links.join(label.select(F.col("digest").alias("a"), F.col("label").alias("x")), "a")
    ends = ends.join(label.select(F.col("digest").alias("b"), F.col("label").alias("y")), "b").filter("x != y").select("x", "y")
    graph = run.save(ends.union(ends.select("y", "x")).distinct(), f"graph-{name}")
    new = graph.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("l"))
    k = 0
    while True:
        k += 1
        around = graph.join(new.select(F.col("x").alias("y"), F.col("l").alias("m")), "y").groupBy("x").agg(F.min("m").alias("m"))
        near = new.join(around, "x").select("x", F.least("l", "m").alias("l"))
        over = new.select(F.col("x").alias("l"), F.col("l").alias("o"))
        new = run.save(near.join(over, "l", "left").select("x", F.least("l", F.coalesce("o", "l")).alias("l")), f"merge-{name}-{k}")
        apart = graph.join(new, "x").join(new.select(F.col("x").alias("y"), F.col("l").alias("o")), "y").filter("l != o")
        if apart.isEmpty():
            break
    label = label.join(new.select(F.col("x").alias("label"), "l"), "label", "left").select("digest", F.coalesce("l", "label").alias("label"))
    return run.save(label, f"label-{name}")


def open_members(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members of the buckets that lie in several components: key, digest, label, whether outside the largest component.

    The centre has been compared with all others, so buckets of two are closed and a centre is never outside.
    """
    m = members.filter("members > 2").select("key", "digest", "bytes", (F.col("digest") == F.col("centre")).alias("done")).join(label, "digest")
    parts = m.groupBy("key", "label").agg(F.count("*").alias("n"), F.count_if(~F.col("done")).alias("fresh"))
    main = parts.groupBy("key").agg(F.max_by("label", F.struct("fresh", "n", "label")).alias("main"), F.count("*").alias("parts"))
    m = m.filter("NOT done").drop("done").join(main.filter("parts > 1").drop("parts"), "key")
    m = m.withColumn("outside", F.col("label") != F.col("main")).drop("main")
    return m.join(m.filter("outside").select("key").distinct(), "key", "left_semi")


def _block_links(group: pa.Table) -> pa.Table:
    """Links that join components, between the texts of side a and those of side b."""
    n = group.num_rows
    side, label = group["side"].to_numpy(), np.unique(group["label"].to_pylist(), return_inverse=True)[1].copy()
    bands = group["bands"].combine_chunks()
    ends, keys = np.cumsum(bands.value_lengths().to_numpy()), bands.flatten().to_numpy()
    begins = np.concatenate([[0], ends[:-1]])
    # of the weighted signature and of the set
    own, plain = keys[begins[:, None] + np.arange(BANDS)], keys[ends[:, None] - BANDS + np.arange(BANDS)]
    key = group["key"][0].as_py()
    band = int(np.flatnonzero((own[0] == key) | (plain[0] == key))[0])
    own, plain = own[:, :band], plain[:, :band]
    parts = []
    for lo, _, buf, offsets in flat.chunks(group["text"]):
        row, gram, weight = weighted_shingles(buf, offsets)
        parts.append((row + lo, gram, weight))
    row, gram, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    size = np.bincount(row, minlength=n)
    heavy = np.bincount(row, weight > 1, n) > 0
    # one bit for each shingle that two texts or more hold
    _, which, held = np.unique(gram, return_inverse=True, return_counts=True)
    shared = held > 1
    place = (np.cumsum(shared) - 1)[which]
    row, place = row[shared[which]], place[shared[which]]
    bits = np.zeros((n, int(shared.sum()) // 64 + 1), np.uint64)
    np.add.at(bits, (row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))

    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    links = []
    for i in left:
        j = right[label[right] != label[i]]
        j = j[~((own[j] == own[i]) | (plain[j] == plain[i]) | (own[j] == plain[i]) | (plain[j] == own[i])).any(axis=1)]
        if not len(j):
            continue
        both = np.bitwise_count(bits[j] & bits[i]).sum(axis=1).astype(np.int64)
        alike = both >= THRESHOLD * (size[i] + size[j] - both)
        unsure = np.flatnonzero(~alike & (heavy[i] | heavy[j]) & (both > 0))
        for lo in range(0, len(unsure), 64):
            some = unsure[lo:lo + 64]
            text = group["text"].combine_chunks()
            alike[some] = similarities(text.take(pa.array([i] * len(some))), text.take(pa.array(j[some])))[0] >= THRESHOLD
        for k in j[alike]:
            if label[k] != label[i]:
                links.append((i, k))
                label[label == label[k]] = label[i]
    a, b = (pa.array([x[k] for x in links], pa.int64()) for k in (0, 1))
    return pa.table({"a": group["digest"].take(a).cast(pa.binary()), "b": group["digest"].take(b).cast(pa.binary())})


def open_links(left: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components, from all pairs of the open buckets with an outside member."""
    order = Window.partitionBy("key").orderBy("digest")
    block = F.floor((F.sum(F.col("bytes") + OVERHEAD).over(order) - 1) / BLOCK)
    a = left.filter("outside").select("key", "digest", "label", F.lit(0).alias("side"), block.alias("block"))
    b = left.select("key", "digest", "label", F.lit(1).alias("side"), block.alias("block"))
    last = lambda x, name: x.groupBy("key").agg(F.max("block").alias(name))
    a, b = (a.join(last(b, "others"), "key"), b.join(last(a, "others"), "key"))
    rows = a.unionByName(b).join(texts_of(docs, left.select("digest").distinct()), "digest").join(texts.select("digest", "bands"), "digest")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others"))))
    rows = rows.withColumns({"x": F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("other")),
                             "y": F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("block"))})
    return rows.select("key", "x", "y", "side", "digest", "label", "bands", "text").groupBy("key", "x", "y").applyInArrow(
        _block_links, "a binary, b binary")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, digest of the text and of the class for every row of ``docs``."""
    run = Run(docs.sparkSession, "near")
    rows = run.save(sketch(docs), "sketch")
    texts = run.save(rows.groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.first("bytes").alias("bytes"),
        F.first("bands").alias("bands"), F.first("sig").alias("sig")), "texts")
    spread = texts.select("digest", "bytes", F.explode(F.array_distinct("bands")).alias("key"))
    buckets = spread.groupBy("key").agg(F.min("digest").alias("centre"), F.count("*").alias("members")).filter("members > 1")
    members = run.save(spread.join(buckets, "key"), "members")
    pairs = members.filter("digest != centre").select(F.col("centre").alias("a"), F.col("digest").alias("b")).distinct()
    label = members.select("digest", F.col("digest").alias("label")).distinct()
    label = merge(label, verify(pairs, texts, docs, run), run, "star")
    left = run.save(open_members(members, label), "open")
    label = merge(label, run.save(open_links(left, texts, docs), "open-links"), run, "open")
    of = texts.select("digest", "first_id", "n").join(label, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    total = of.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    out = of.select("digest", "label").join(total, "label")
    return rows.select("doc_id", "digest").join(out, "digest").select("doc_id", "class_id", "class_size", "digest", "label")


def keep(docs: DataFrame) -> DataFrame:
    """One document of each class: a row with the least id, with all its columns."""
    out = classes(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    firsts = out.groupBy("label").agg(F.first("class_id").alias("_near_id"), F.min("digest").alias("_near_text")).drop("label")
    marked = docs.withColumn("_near_digest", digest("text"))
    marked = marked.join(firsts, F.col("doc_id").eqNullSafe(F.col("_near_id")) & (F.col("_near_digest") == F.col("_near_text")), "left_semi")
    return marked.dropDuplicates(["doc_id", "_near_digest"]).drop("_near_digest")
