"""Regex matches with their places, in Spark SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUP = 256
SPAN = "array<struct<start:int,end:int,match:string>>"


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: (start, end, match) in code points, end exclusive.

    The pieces between matches come from ``split`` with the same pattern, so running sums of
    the lengths of pieces and matches give the places. Sums run over groups of ``GROUP`` matches and then over
    the groups, since every step copies the array that it adds to. The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def add_group(acc: Column, group: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), none().alias("spans"))
        done = F.array(F.aggregate(group, begin, add))  # in an array, so that it is made once
        return F.transform(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["parts"], F.array(d["spans"])).alias("parts")))[0]

    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("match"))
    groups = F.transform(F.array(zipped), lambda z: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(z) - 1) / GROUP).cast("int")), lambda i: F.slice(z, i * GROUP + 1, GROUP)))[0]
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("parts"))
    places = F.flatten(F.aggregate(groups, zero, add_group, lambda acc: acc["parts"]))
    return F.when(text.rlike(pattern), places).otherwise(none())


def none() -> Column:
    return F.array().cast(SPAN)


def tagged(kind: int, spans: Column) -> Column:
    """(start, end, kind) of spans."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def listing(spans: Column, kinds: list[str], by: list[str]) -> Column:
    """kind:start:end of tagged spans, ordered by the named fields and comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(*[x[f].alias(f) for f in by], x["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
