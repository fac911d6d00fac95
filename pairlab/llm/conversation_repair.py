"""Cheapest repair of role order and broken turns, by a dynamic program with checkpoints.

Rows of a conversation stand in order of turn (nulls first), then role, then a hash of the text. A row is blank
(no character but white space), else a duplicate (role and text seen earlier), else truncated (its last
character that is no white space is none of ``. ! ?``). The repaired role initials must read
``(s?(ua)+)?``. Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows
must go), Insert an empty user or assistant turn 5, and 5 more for a truncated row that stays. Of the
cheapest sequences of edits the ASCII-least one is taken.

How it runs:

1. Equal rows of one turn are counted before anything moves; first occurrences come from a grouped
   minimum; only keys, codes and 64-bit hashes take part, texts stay behind.
2. A range partitioning by (conversation, turn, role, hash) orders the rows, so a conversation of any
   length spreads over many tasks. Each task packs its rows into segments of at most ``SEGMENT`` rows.
3. A segment of m rows is walked with checkpoints: backward vectors are stored at every sqrt(m)-th row
   only, and each block between two checkpoints is recomputed while the walk goes forward along tight
   edits. A segment that is a whole conversation is walked at once.
4. Conversations that go on over several segments: the min-plus matrices of the segments, one short row for
   each, are multiplied backward, which gives the state-cost vector at each segment's end, the outer
   checkpoints. Segments are then walked in tasks of their own for each state in which they can be
   entered, and the entry states are passed on forward, again over one short row for each segment.
5. The edits are joined to the texts by the full key.

Vectors differ by bounded amounts, so after the least cost is taken out only a few occur: steps of the
program are looked up by (row code, vector).

Defined cases: null role or text is one space; a null conversation id is a conversation of its own; a role
is known by its first character, any other than s, u, a must be changed or deleted. An empty table gives
empty results. Columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlab.llm.scratch import Run

SEGMENT = 1 << 16
#: Segments of long conversations that one task exchanges checkpoints for.
EXCHANGE = 50_000
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. By state: where a fitting user or assistant turn leads.
NEXT = (2, 2, 3, 2)
#: By initial (s, u, a, other) and state: where keeping the row leads, or -1.
KEEP = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
LEGAL = {(0, 1), (1, 2), (2, 1)}
ROLE = {2: "user", 3: "assistant"}
FAR = 1 << 40
FINAL = (0, 2 * INSERT, INSERT, 0)  # costs after the last row

Vector = tuple[int, int, int, int]


def _least(costs: list[int]) -> tuple[int, Vector]:
    low = min(costs)
    return low, tuple(min(c - low, FAR) if c < FAR else FAR for c in costs)


@lru_cache(maxsize=None)
def _before(code: int, after: Vector) -> tuple[int, Vector]:
    """(least cost, vector over it) in front of a row of this code, from the vector behind it.

    Code 0 must go; else it is 1 + 2 * initial + (1 if truncated).
    """
    out = []
    for state in range(4):
        best = DELETE + after[state]
        if code:
            initial, extra = (code - 1) >> 1, TRUNCATED * ((code - 1) & 1)
            keep = KEEP[initial][state]
            if keep >= 0:
                best = min(best, extra + after[keep])
            best = min(best, REROLE + extra + after[NEXT[state]])
        out.append(best)
    for state in (2, 3, 2, 0, 1):
        out[state] = min(out[state], INSERT + out[NEXT[state]])
    return _least(out)


@lru_cache(maxsize=None)
def _edits(code: int, after: Vector, state: int) -> tuple[str, int]:
    """The ASCII-least tight edits from in front of a row to behind it, and the state reached."""
    low, before = _before(code, after)
    done = ""
    while True:
        cost = low + before[state]
        if DELETE + after[state] == cost:
            return done + "D", state
        if INSERT + low + before[NEXT[state]] == cost:
            done, state = done + "I", NEXT[state]
            continue
        initial, extra = (code - 1) >> 1, TRUNCATED * ((code - 1) & 1)
        keep = KEEP[initial][state]
        if keep >= 0 and extra + after[keep] == cost:
            return done + "K", keep
        return done + "R", NEXT[state]


def _back(codes: bytes, vector: Vector) -> tuple[int, Vector]:
    """Cost taken out and vector in front of the rows."""
    total = 0
    for code in reversed(codes):
        low, vector = _before(code, vector)
        total += low
    return total, vector


def matrix(codes: bytes) -> list[int]:
    """Costs from each entry state (outer) to each exit state (inner), ``FAR`` where there is no way."""
    columns = []
    for leave in range(4):
        total, vector = _back(codes, tuple(0 if s == leave else FAR for s in range(4)))
        columns.append([v + total if v < FAR else FAR for v in vector])
    return [columns[leave][enter] for enter in range(4) for leave in range(4)]


def walk(codes: bytes, end: Vector, entries: tuple[int, ...], last: bool) -> list[tuple[str, int]]:
    """(edits, exit state) from each entry state; ``end`` is the vector behind the last row."""
    step = isqrt(len(codes)) + 1
    places = list(range(0, len(codes), step))
    checkpoints = {len(codes): end}
    vector = end
    for place in reversed(places):
        _, vector = _back(codes[place:place + step], vector)
        checkpoints[place] = vector
    states, done = list(entries), [[] for _ in entries]
    for place in places:
        stop = min(place + step, len(codes))
        after = [checkpoints[stop]]
        for code in reversed(codes[place + 1:stop]):
            after.append(_before(code, after[-1])[1])
        for k, state in enumerate(states):
            for i in range(place, stop):
                edits, state = _edits(codes[i], after[stop - 1 - i], state)
                done[k].append(edits)
            states[k] = state
    out = []
    for state, parts in zip(states, done):
        while last and FINAL[state]:
            parts.append("I")
            state = NEXT[state]
        out.append(("".join(parts), state))
    return out


# --- packing ordered rows into segments -------------------------------------------------------------

COUNTS = ("n_turns", "blank", "duplicate", "truncated", "illegal")


def _segment_type(conv: T.DataType, turn: T.DataType) -> T.StructType:
    """A segment; ``edits`` and ``cost`` are set where it is a whole conversation, else ``matrix``."""
    long, of = T.LongType(), T.ArrayType
    return T.StructType(
        [T.StructField("conv", conv), T.StructField("segment", long), T.StructField("codes", T.BinaryType()), T.StructField("initials", T.BinaryType()),
         T.StructField("turns", of(turn)), T.StructField("roles", of(T.StringType())), T.StructField("hashes", of(long)),
         T.StructField("edits", T.StringType()), T.StructField("cost", long), T.StructField("matrix", of(long)),
         T.StructField("first_turn", turn), T.StructField("last_turn", turn)] + [T.StructField(n, long) for n in COUNTS])


class _Segment:
    def __init__(self, conv):
        self.conv, self.codes, self.initials = conv, bytearray(), bytearray()
        self.turns, self.roles, self.hashes = [], [], []
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role, text_hash, code, initial, blank):
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.n_turns += 1
        if self.initials and (self.initials[-1], initial) not in LEGAL:
            self.illegal += 1
        self.blank += code == 0 and blank
        self.duplicate += code == 0 and not blank
        self.truncated += code > 0 and code % 2 == 0
        self.codes.append(code), self.initials.append(initial)
        self.turns.append(turn), self.roles.append(role), self.hashes.append(text_hash)

    def row(self, number: int, whole: bool) -> dict:
        codes = bytes(self.codes)
        out = {"conv": self.conv, "segment": number, "codes": codes, "initials": bytes(self.initials), "turns": self.turns, "roles": self.roles,
               "hashes": self.hashes, "edits": None, "cost": None, "matrix": None, "first_turn": self.turns[0], "last_turn": self.turns[-1]}
        if whole:
            total, vector = _back(codes, FINAL)
            out |= {"edits": walk(codes, FINAL, (0,), True)[0][0], "cost": total + vector[0]}
        else:
            out["matrix"] = matrix(codes)
        return out | {n: getattr(self, n) for n in COUNTS}


def _batches(rows: Iterator[tuple[int, dict]], schema: pa.Schema, size: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``size`` from (weight, row)."""
    held, weight = [], 0
    for w, row in rows:
        held.append(row)
        weight += w
        if weight >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _mapped(df: DataFrame, work, schema: T.StructType) -> DataFrame:
    """``work``: iterator of row tuples -> iterator of (weight, dict), as Arrow batches."""
    arrow = _arrow(schema)

    def run(batches):
        yield from _batches(work(_rows(batches)), arrow)

    return df.mapInArrow(run, schema)


def _pack(rows):
    number = TaskContext.get().partitionId() << 40  # numbers ascend in the order of the range partitions
    now, begun = None, False  # begun: the conversation starts in this partition, as another one stands before it

    for conv, turn, role, text_hash, initial, code, blank, copies in rows:
        for k in range(copies):
            if now is None:
                now = _Segment(conv)
            elif now.conv != conv:
                yield len(now.codes), now.row(number, begun)
                now, number, begun = _Segment(conv), number + 1, True
            elif len(now.codes) >= SEGMENT:
                yield len(now.codes), now.row(number, False)
                now, number, begun = _Segment(conv), number + 1, False
            now.add(turn, role, text_hash, code if k == 0 else 0, initial, blank)
    if now is not None:
        yield len(now.codes), now.row(number, False)  # it may go on in the next partition


def _checkpoints(rows):
    """Segments of a conversation from its last to its first: the vector at each one's end."""
    held = None  # (conv, row) whose place in the conversation is known when the next row is seen
    for conv, segment, costs in rows:
        if held is None or held[0] != conv:
            if held is not None:
                yield 1, {**held[1], "first": True}
            end, total, last = FINAL, 0, True
        else:
            yield 1, {**held[1], "first": False}
            last = False
        low, before = _least([min(costs[4 * s + t] + end[t] for t in range(4)) for s in range(4)])
        held = conv, {"segment": segment, "end": list(end), "last": last, "cost": total + low + before[0]}
        end, total = before, total + low
    if held is not None:
        yield 1, {**held[1], "first": True}


def _walked(rows):
    for segment, codes, end, first, last in rows:
        ways = walk(codes, tuple(end), (0,) if first else (0, 1, 2, 3), last)
        yield len(codes), {"segment": segment, "edits": [e for e, _ in ways], "exits": [s for _, s in ways]}


def _entries(rows):
    """Segments of a conversation in order: the state each is entered in, and what its seam with the one before changes."""
    conv = state = initial = turn = None
    for c, segment, first, exits, initials, first_turn, last_turn in rows:
        state = 0 if first else state
        seam = not first and (initial, initials[0]) not in LEGAL
        again = not first and first_turn is not None and first_turn == turn
        yield 1, {"segment": segment, "enter": state, "seam": int(seam), "again": int(again)}
        conv, state, initial, turn = c, exits[0 if first else state], initials[-1], last_turn


def _listed(rows):
    for conv, segment, state, edits, initials, turns, roles, hashes in rows:
        i = 0
        for place, edit in enumerate(edits):
            out = {"conv": conv, "segment": segment, "place": place, "edit": edit, "turn": None, "role": None, "hash": None, "new_role": None}
            if edit == "I":
                state = NEXT[state]
                out["new_role"] = ROLE[state]
            else:
                out |= {"turn": turns[i], "role": roles[i], "hash": hashes[i]}
                if edit == "K":
                    state = KEEP[initials[i]][state]
                    out["new_role"] = roles[i]
                elif edit == "R":
                    state = NEXT[state]
                    out["new_role"] = ROLE[state]
                i += 1
            yield 1, out


# --- the operator -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Repair:
    """``faults``: one row for each conversation (gaps, blank, duplicate, truncated, illegal, cost).
    ``edits``: conv, segment, place (their order), edit, turn, role, hash, new_role.
    ``rows``: ``edits`` with the text of rows that stay; inserted ones have an empty text."""

    faults: DataFrame
    edits: DataFrame
    rows: DataFrame


def _facts(rows: DataFrame) -> DataFrame:
    """conv, turn, role, hash, text and what the text tells."""
    shown = F.rtrim("text", F.lit(SPACES))
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    return rows.select("conv", "turn", "role", F.xxhash64("text").alias("hash"), initial.alias("initial"), (shown == "").alias("blank"),
                       (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "text")


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the keys come from the left."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(named, same, how).drop(*[f"_{k}" for k in keys])


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    spark = conversations.sparkSession
    at = Run(spark, "conversation-repair")
    facts = _facts(conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
                                        F.coalesce(text, F.lit(" ")).alias("text")))
    conv_type, turn_type = facts.schema["conv"].dataType, facts.schema["turn"].dataType

    key = ["conv", "turn", "role", "hash"]
    turns = facts.groupBy(*key).agg(F.count("*").alias("copies"), F.max("initial").alias("initial"), F.max("blank").alias("blank"),
                                    F.max("truncated").alias("truncated"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    seen = (turns.filter(~F.col("blank")).groupBy("conv", "role", "hash").agg(F.min(order).alias("first"), F.count("*").alias("n"))
            .filter("n > 1").drop("n"))
    first = F.col("first").isNull() | ((F.col("first.known") == order["known"]) & F.col("first.turn").eqNullSafe(F.col("turn")))
    code = F.when(F.col("blank") | ~first, 0).otherwise(1 + 2 * F.col("initial") + F.col("truncated").cast("int"))
    coded = _matched(turns, seen, ["conv", "role", "hash"], "left").select(*key, "initial", code.alias("code"), "blank", "copies")
    by = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]
    ordered = coded.repartitionByRange(*by).sortWithinPartitions(*by)
    segments = at.save(_mapped(ordered, _pack, _segment_type(conv_type, turn_type)), "segments")

    long, short = T.LongType(), T.IntegerType()
    number = T.StructField("segment", long)
    open_ = segments.filter("matrix is not null")
    tasks = 1 + open_.count() // EXCHANGE  # the exchanged rows are few and short, whatever the number of partitions
    ends = at.save(_mapped(
        open_.select("conv", "segment", "matrix").repartition("conv").coalesce(tasks).sortWithinPartitions("conv", F.desc("segment")), _checkpoints,
        T.StructType([number, T.StructField("end", T.ArrayType(long)), T.StructField("last", T.BooleanType()), T.StructField("cost", long),
                      T.StructField("first", T.BooleanType())])), "ends")
    walked = at.save(_mapped(
        open_.select("segment", "codes").join(ends, "segment").select("segment", "codes", "end", "first", "last"), _walked,
        T.StructType([number, T.StructField("edits", T.ArrayType(T.StringType())), T.StructField("exits", T.ArrayType(short))])), "walked")
    seams = open_.drop("edits", "cost").join(walked.select("segment", "exits"), "segment").join(ends.select("segment", "first"), "segment")
    entered = at.save(_mapped(
        seams.select("conv", "segment", "first", "exits", "initials", "first_turn", "last_turn").repartition("conv").coalesce(tasks)
        .sortWithinPartitions("conv", "segment"), _entries, T.StructType([number, T.StructField("enter", short), T.StructField("seam", short), T.StructField("again", short)])), "entered")
    joined = (open_.drop("edits", "cost").join(entered, "segment").join(walked.select("segment", F.col("edits").alias("ways")), "segment")
              .join(ends.select("segment", "first", F.when(F.col("first"), F.col("cost")).alias("cost")), "segment")
              .withColumn("edits", F.get("ways", F.when(F.col("first"), 0).otherwise(F.col("enter")))).drop("ways", "first"))
    whole = segments.filter("matrix is null").select("*", *[F.lit(0).alias(n) for n in ("enter", "seam", "again")])
    settled = whole.unionByName(joined)

    earliest = F.get(F.filter("turns", lambda t: t.isNotNull()), F.lit(0))  # nulls come first, so a segment may begin with them
    gaps = F.max("last_turn") - F.min(earliest) + 1 - F.sum(F.col("n_turns") - F.col("again"))
    faults = settled.groupBy("conv").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"),
        F.sum("truncated").alias("truncated"), F.sum(F.col("illegal") + F.col("seam")).alias("illegal"), F.max("cost").alias("cost"))
    edits = _mapped(
        settled.select("conv", "segment", "enter", "edits", "initials", "turns", "roles", "hashes"), _listed,
        T.StructType([T.StructField("conv", conv_type), number, T.StructField("place", short), T.StructField("edit", T.StringType()),
                      T.StructField("turn", turn_type), T.StructField("role", T.StringType()), T.StructField("hash", long),
                      T.StructField("new_role", T.StringType())]))

    # rows without a text look for a role that no text has, under a hash that spreads them
    wanted = edits.withColumns({"want_role": F.when(F.col("edit").isin("K", "R"), F.col("role")),
                                "want_hash": F.coalesce("hash", F.xxhash64("segment", "place"))})
    texts = facts.groupBy(*key).agg(F.any_value("text").alias("found")).withColumnsRenamed({"role": "want_role", "hash": "want_hash"})
    rows = _matched(wanted, texts, ["conv", "turn", "want_role", "want_hash"], "left").select(
        *edits.columns, F.when(F.col("edit") == "I", "").otherwise(F.col("found")).alias("text"))
    return Repair(faults.withColumnRenamed("conv", conv), edits, rows)


# --- the query's input and digest -------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """Rows by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20: 0 drops the row, 1 empties its text, 2 removes
    its ``. ! ?``, 3 repeats it, 4 makes its role user."""
    null = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), null), F.coalesce(F.col("turn").cast("string"), null))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", null), F.coalesce("role", null)
    return conversations.filter(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _digested(rows):
    """Rows of one conversation after another, in order: the edits and a running checksum of ``role:text`` lines."""
    conv, begun, sha, audit, lines = None, False, None, [], 0
    for c, edit, role, text in rows:
        if not begun or c != conv:
            if begun:
                yield len(audit), {"conv": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
            conv, begun, sha, audit, lines = c, True, hashlib.sha256(), [], 0
        audit.append(edit)
        if edit != "D":
            sha.update((("\n" if lines else "") + f"{role}:{text}").encode())
            lines += 1
    if begun:
        yield len(audit), {"conv": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}


def digest(original: DataFrame, fixed: Repair) -> DataFrame:
    """One row for each conversation of ``original``. The checksum reads a conversation's rows as a sorted stream,
    never as a whole."""
    conv_type = fixed.rows.schema["conv"].dataType
    stream = (fixed.rows.select("conv", "segment", "place", "edit", "new_role", "text").repartition("conv")
              .sortWithinPartitions("conv", "segment", "place").select("conv", "edit", "new_role", "text"))
    sums = _mapped(stream, _digested, T.StructType([T.StructField("conv", conv_type), T.StructField("audit", T.StringType()),
                                                    T.StructField("repaired_sha256", T.StringType())]))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = (original.select("conv_id").unionByName(fixed.faults, allowMissingColumns=True)
             .unionByName(sums.withColumnRenamed("conv", "conv_id"), allowMissingColumns=True))
    return every.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
