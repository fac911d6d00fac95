"""Secret scans over a trigram inverted index, in DataFrame and SQL functions only.

From each rule's regular expression follows a Boolean query over trigrams of the lower-cased text that
every match must contain: an OR of ANDs, found by walking the parsed expression. The corpus is indexed by
those trigrams (postings of trigram and document), the postings of each AND are intersected by counting, and
only candidate documents are verified with the expression itself. A rule without mandatory trigrams is
verified on every document.

Base rules (``BASE``) report as the contract says; the other rules add spans.

Defined cases. Null or empty text: no spans. Null or repeated doc_ids: one result row for each input row; postings go
by (doc_id, hash of the text), and a false candidate costs one verification and changes nothing. Empty input: no
rows. Other columns are ignored. A text with k matches of one rule costs O(k * k) array copies.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlab.llm import spans
from pairlab.llm.scratch import Run

# re._parser is the standard library's parser of regular expressions
_parse = re._parser.parse

#: Kinds and their expressions (Java and Python read them alike), as listed.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
MORE = {
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google": r"AIza[A-Za-z0-9_-]{35}",
    "stripe": r"[rs]k_live_[A-Za-z0-9]{16,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "pem": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
    "login": r"(?:https?|ftp|ssh|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._%+!-]{1,128}@",
    "bearer": r"(?i:bearer)\x20{1,8}[A-Za-z0-9._~+/-]{20,}",
}
RULES = BASE | MORE
KINDS = list(RULES)
#: Characters that the value of an assignment needs.
VALUE = 6
#: Most strings that the analysis of an expression keeps apart.
EXACT = 64


def _product(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x, y in itertools.product(a, b)} if len(a) * len(b) <= EXACT else None


def _runs(parsed) -> list[list[set[str] | None]]:
    """The expression as a sequence of sets of strings; None stands for anything."""
    out: list[set[str] | None] = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out.append({chr(arg).lower()})
        elif name == "IN":
            some = {chr(v).lower() for o, v in arg if str(o) == "LITERAL"}
            out.append(some if all(str(o) == "LITERAL" for o, _ in arg) and len(some) <= 8 else None)
        elif name == "SUBPATTERN":
            out += _runs(arg[3])
        elif name == "BRANCH":
            whole = [_strings(_runs(b)) for b in arg[1]]
            out.append(set().union(*whole) if None not in whole and len(set().union(*whole)) <= EXACT else None)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, sub = arg
            one = _strings(_runs(sub))
            if one is not None and low == high and low <= 4:
                out += [one] * low
            elif one is not None and low == 0 and high == 1:
                out.append(one | {""})
            else:
                out += [one] * min(low, 2) + [None]
        elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
            out.append(None)
    return out


def _strings(run: list[set[str] | None]) -> set[str] | None:
    whole: set[str] | None = {""}
    for part in run:
        whole = None if whole is None or part is None else _product(whole, part)
    return whole


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of trigrams that every match's lower-cased text holds; empty: no mandatory trigram."""
    best: list[frozenset[str]] = []
    pieces: list[set[str]] = [{""}]
    for part in [*_runs(_parse(pattern)), None]:
        joined = _product(pieces[-1], part) if part is not None else None
        if joined is not None:
            pieces[-1] = joined
            continue
        pieces.append(part if part is not None else {""})
    for words in pieces:
        if all(len(w) >= 3 for w in words):
            clauses = {frozenset(w[i:i + 3] for i in range(len(w) - 2)) for w in words}
            query = sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)
            if not best or min(map(len, query)) > min(map(len, best)):
                best = query
    return best


QUERIES = {k: trigram_query(p) for k, p in RULES.items()}
TRIGRAMS = sorted({t for q in QUERIES.values() for c in q for t in c})
KEYS = ["doc_id", "_text_hash"]


def _key() -> Column:
    return F.xxhash64("text").alias("_text_hash")


def postings(docs: DataFrame) -> DataFrame:
    """The inverted index: trigram, doc_id, hash of the text."""
    own = docs.select("doc_id", _key(), F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in TRIGRAMS]), lambda t: t.isNotNull())
    return own.select(F.explode(held).alias("trigram"), *KEYS)


def candidates(index: DataFrame) -> DataFrame:
    """doc_id, hash of the text, kinds whose trigram query the document meets."""
    spark = index.sparkSession
    parts = [(t, k, i, len(c)) for k, q in QUERIES.items() for i, c in enumerate(q) for t in c]
    query = spark.createDataFrame(parts, "trigram string, kind string, clause int, need int")
    met = index.distinct().join(F.broadcast(query), "trigram").groupBy(*KEYS, "kind", "clause").agg(
        F.count("*").alias("n"), F.first("need").alias("need")).filter("n = need")
    return met.groupBy(*KEYS).agg(F.collect_set("kind").alias("kinds"))


def _rule_spans(kind: str) -> Column:
    """Spans of a rule; the value of an assignment must have VALUE characters or more."""
    found = spans.find(F.col("text"), RULES[kind])
    if kind == "assign":
        value = RULES[kind]
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["match"], value, 1)) >= VALUE)
    if QUERIES[kind]:
        return F.when(F.array_contains("kinds", kind), found).otherwise(spans.none())
    return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, its spans (start, end, match) in the whole text."""
    run = Run(docs.sparkSession, "secrets")
    index = run.save(postings(docs), "postings")
    held = candidates(index).select(F.col("doc_id").alias("c_id"), F.col("_text_hash").alias("c_hash"), "kinds")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _key())
    own = own.join(held, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("_text_hash") == F.col("c_hash")), "left")
    return own.select("doc_id", *[_rule_spans(k).alias(k) for k in KINDS])


def report(found: DataFrame) -> DataFrame:
    """The contract's digest columns."""
    base = [spans.tagged(i, F.col(k)) for i, k in enumerate(KINDS) if k in BASE]
    every = [spans.tagged(i, F.col(k)) for i, k in enumerate(KINDS)]
    by = ["start", "kind"]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(spans.listing(reduce(F.concat, base), KINDS, by), 256).alias("base_sha256"),
        spans.listing(reduce(F.concat, every), KINDS, by).alias("spans"))
