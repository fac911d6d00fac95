"""PII by candidate gradient boosting, in DataFrame and SQL functions only.

Generators with high recall propose spans, which may overlap: the base matches of the contract, digit groups of card
size inside longer runs, national and international phone shapes, dotted quads inside longer ones, and spelled-out
mail addresses. Boosted trees see the format (length, digits, groups, separators, checksum, octets) and the
context (neighbouring characters, cue words before) of each candidate. They learn from candidates whose kind a
validator can decide, from all of three quarters of the texts, chosen by hash; all candidates of the others
calibrate a threshold for each kind: the least probability from which on the share of valid candidates is ``PRECISION``.
Candidates alike in features and label are one row that weighs as much as there are.
Base spans always stay; a further candidate is selected if its probability reaches its kind's threshold and it
overlaps no base span and no better candidate.

Patterns use possessive repeats and begin only where a run begins or the last match ended (``\\G``), which gives the
same matches as the plain ones without their quadratic cost on very long runs; that of cards takes whole runs of 16
to 19 digits, since all others fail. Overlaps are found by windows over a text's candidates in order, and the
best of overlapping candidates within each chain of overlaps.

Defined cases. Null or empty text: no spans. Too few labelled candidates of either sort: base spans only.
Null or repeated doc_ids: one result row for each row. Empty input: no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm import spans, trees
from pairlab.llm.scratch import Run

#: Kinds as listed, with the contract's patterns and those of the generators.
KINDS = ["email", "ip", "card", "phone"]
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = [
    ("email", r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{1,63}+(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?)[a-z0-9-]{2,63}+){1,4}"),
    ("ip", r"(?<![0-9])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,4}(?![0-9])"),
    ("phone", r"(?<![0-9+])\(?[0-9]{3,5}\)?[\x20./-][0-9]{3}[\x20.-]?[0-9]{3,4}(?![0-9])"),
]
CUES = {"cue_phone": "tel|phone|call|mobil|fax|handy|appel", "cue_card": "card|visa|credit|karte|carte|tarjeta|konto|iban",
        "cue_mail": "mail|contact|kontakt|write|correo", "cue_ip": r"\bip\b|host|server|addr|ping"}
FEATURES = ["kind", "length", "digits", "groups", "longest", "spaces", "dots", "hyphens", "brackets", "plus", "letters", "luhn",
            "octets", "before_word", "after_word", "before_sign", "after_sign", *CUES]
PRECISION = 0.98
NEAR = 24
KEYS = ["doc_id", "_text_hash"]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def value(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, 1).cast("int")
        return F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    places = F.sequence(F.lit(0), F.length(d) - 1)
    total = F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(d) > 0, total % 10 == 0).otherwise(False)


def octets(text: Column) -> Column:
    """Whether every dotted part is at most 255."""
    return text.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")


def _valid(kind: str, x: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return octets(x)
    n = F.length(digits(x))
    return n.between(8, 15) if kind == "phone" else n.between(16, 19) & luhn(digits(x))


def _generated(text: Column) -> Column:
    """Candidates: kind, start, end, match, characters before and after, whether a base span."""
    def near(k: int, found: Column, own: Column | None) -> Column:
        return F.transform(found, lambda x: F.struct(
            F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"),
            F.substring(text, F.greatest(x["start"] - NEAR, F.lit(0)) + 1, x["start"] - F.greatest(x["start"] - NEAR, F.lit(0))).alias("before"),
            F.substring(text, x["end"] + 1, F.lit(1)).alias("after"),
            (_valid(KINDS[k], x["match"]) if own is None else own).alias("own")))

    found = [near(KINDS.index(k), spans.find(text, p), None) for k, p in BASE.items()]
    found += [near(KINDS.index(k), spans.find(text, p), F.lit(False)) for k, p in GENERATORS]
    return reduce(F.concat, found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text, candidates."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return own.select("doc_id", F.xxhash64("text").alias("_text_hash"), _generated(F.col("text")).alias("candidates"))


def base_spans(kind: int) -> Column:
    """(start, end, kind) of a kind's base spans."""
    own = F.filter("candidates", lambda c: c["own"] & (c["kind"] == kind))
    return F.transform(own, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(kind).alias("kind")))


def described(found: DataFrame) -> DataFrame:
    """One row for each distinct candidate of each distinct text: span, features, whether it is a base span or meets one."""
    rows = found.filter(F.size("candidates") > 0).dropDuplicates(KEYS).select(*KEYS, F.explode("candidates").alias("c")).select(*KEYS, "c.*")
    rows = rows.groupBy(*KEYS, "kind", "start", "end").agg(
        F.first("match").alias("match"), F.first("before").alias("before"), F.first("after").alias("after"), F.max("own").alias("own"))
    m, d = F.col("match"), digits(F.col("match"))
    count = lambda chars: F.length(m) - F.length(F.regexp_replace(m, f"[{chars}]", ""))
    last = F.substring("before", -1, 1)
    values = {
        "length": F.length(m), "digits": F.length(d), "groups": F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))),
        "longest": F.array_max(F.concat(F.array(F.lit(0)), F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), F.length))),
        "spaces": count(r"\x20"), "dots": count("."), "hyphens": count(r"\-"), "brackets": count("()"), "plus": count("+"),
        "letters": count("A-Za-z"), "luhn": luhn(F.substring(d, 1, 40)), "octets": octets(m),
        "before_word": last.rlike(r"[\p{L}0-9]"), "after_word": F.col("after").rlike(r"[\p{L}0-9]"),
        "before_sign": last.rlike(r"[^\p{L}0-9\s]"), "after_sign": F.col("after").rlike(r"[^\p{L}0-9\s]"),
    } | {k: F.lower("before").rlike(v) for k, v in CUES.items()}
    rows = rows.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()})
    by = Window.partitionBy(*KEYS).orderBy("start", "end", "kind")
    ended = F.max(F.when(F.col("own"), F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(F.col("own"), F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    hit = F.coalesce(ended > F.col("start"), F.lit(False)) | F.coalesce(begins < F.col("end"), F.lit(False))
    return rows.withColumns({"hit": hit, "label": _label()})


def _label() -> Column:
    """1 or 0 by the validator of the candidate's kind: a format that the trees see only in part."""
    m, n = F.col("match"), F.col("digits")
    return (F.when(F.col("kind") == 0, (F.col("after_word") == 0).cast("int"))
            .when(F.col("kind") == 1, octets(m).cast("int") * (F.col("after_word") == 0).cast("int"))
            .when(F.col("kind") == 2, (n.between(13, 19) & luhn(digits(m))).cast("int") * (F.col("after_word") == 0).cast("int")
                  * (F.col("before_word") == 0).cast("int"))
            .otherwise((n.between(8, 15) & (F.col("plus") == 1)).cast("int") * (F.col("after_word") == 0).cast("int")))


def thresholds(scored: DataFrame) -> dict[int, float]:
    """For each kind the least hundredth of p from which on the share of label 1 is PRECISION or more, over rows that stand ``times`` each."""
    bins = scored.groupBy("kind", F.floor(F.col("p") * 100).alias("bin")).agg(F.sum("times").alias("n"), F.sum(F.col("label") * F.col("times")).alias("good")).collect()
    out = {}
    for k in range(len(KINDS)):
        n = good = 0
        for r in sorted((r for r in bins if r["kind"] == k), key=lambda r: -r["bin"]):
            n, good = n + r["n"], good + r["good"]
            if good >= PRECISION * n:
                out[k] = r["bin"] / 100
    return out


def _best(found: Column) -> Column:
    """Candidates by falling p without overlaps."""
    ordered = F.array_sort(found)

    def take(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"]))
        one = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(one)))

    return F.aggregate(ordered, F.array().cast("array<struct<start:int,end:int,kind:int>>"), take)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and further spans that the trees select, each (start, end, kind)."""
    run = Run(docs.sparkSession, "pii")
    found = run.save(find(docs), "found")
    rows = run.save(described(found), "described")
    out = found.select(*KEYS, reduce(F.concat, [base_spans(k) for k in range(len(KINDS))]).alias("base"))
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    part = F.pmod(F.xxhash64(F.lit("fold"), *KEYS), F.lit(4))
    alike = run.save(rows.groupBy(*FEATURES, "label", (part == 0).alias("calibrates")).agg(F.count("*").alias("times")), "alike")
    model = trees.fit(alike.filter("NOT calibrates"), FEATURES, times="times")
    if model is None:
        return out.select("doc_id", "base", none.alias("more"))
    limits = thresholds(trees.score(model, alike.filter("calibrates"), FEATURES))
    limit = reduce(lambda a, k: F.when(F.col("kind") == k, limits[k]).otherwise(a), limits, F.lit(2.0))
    picked = trees.score(model, rows.filter("NOT own AND NOT hit"), FEATURES).filter(F.col("p") >= limit)
    # chains of overlapping candidates
    by = Window.partitionBy(*KEYS).orderBy("start", "end", "kind")
    gap = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    picked = picked.select(*KEYS, "start", "end", "kind", "p", gap.cast("int").alias("gap")).withColumn("chain", F.sum("gap").over(by))
    chains = picked.groupBy(*KEYS, "chain").agg(_best(F.collect_list(F.struct(
        (-F.round("p", 6)).alias("rank"), (F.col("start") - F.col("end")).alias("size"), "start", "end", "kind"))).alias("c"))
    more = chains.groupBy(F.col("doc_id").alias("p_id"), F.col("_text_hash").alias("p_hash")).agg(F.flatten(F.collect_list("c")).alias("more"))
    out = out.join(more, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("_text_hash") == F.col("p_hash")), "left")
    return out.select("doc_id", "base", F.coalesce("more", none).alias("more"))


def report(found: DataFrame) -> DataFrame:
    """The contract's digest columns."""
    by = ["kind", "start"]
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(len(KINDS))],
                        F.sha2(spans.listing(F.col("base"), KINDS, by), 256).alias("base_sha256"),
                        spans.listing(F.concat("base", "more"), KINDS, by).alias("spans"))
