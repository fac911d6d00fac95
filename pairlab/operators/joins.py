"""Key lookups into a dimension table (sequence -> embedding).

The probe side (pairs, pool) can be arbitrarily large and skewed: one antigen can sit in a
third of all rows. The join is declared once and its strategy left to Spark: a lookup side below the
session's broadcast threshold (by file statistics, or by its measured size at run time) is broadcast, any other is
shuffled on the key. A shuffled probe side whose key is hot is split over many tasks by adaptive
skew handling, which repeats only that key's lookup rows; the probe side is read once and nothing runs
while the plan is built.

Adaptive skew handling needs an exchange right below the join on both sides. A lookup side that was grouped by its key
has its grouping there instead, so the join is on a name derived from the key. Rows without a key find nothing; they are
dealt over ``ABSENT`` names that no key has, else all of them would meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


#: Names over which the rows without a key are dealt in a left join.
ABSENT = 4096


def _name(key: Column) -> Column:
    return F.concat(F.lit("="), key)


def _absent(df: DataFrame) -> Column:
    """A name that no key has, by a hash of the row's plain columns (vectors are not hashed)."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
    return F.concat(F.lit("-"), F.pmod(F.xxhash64(*plain), F.lit(ABSENT)).cast("string"))


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """``left JOIN right ON left_key = right_key`` for a right side with unique keys (see ``one_per_key``).

    The right key column is dropped from the result. ``how`` is 'inner' or 'left'.
    """
    if how not in ("inner", "left"):
        raise ValueError("lookup_join supports inner and left joins")
    name = _name(F.col(left_key))
    probe = left.withColumn("_probe_name", name if how == "inner" else F.coalesce(name, _absent(left)))
    side = right.withColumn("_side_name", _name(F.col(right_key))).drop(right_key)
    return probe.join(side, F.col("_probe_name") == F.col("_side_name"), how).drop("_probe_name", "_side_name")


def one_per_key(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, vec) with one row for each key: the last by (``_file``, ``_pos``) where the table carries its
    file order, else the largest vector (any rule that does not depend on partitions)."""
    if {"_file", "_pos"} <= set(df.columns):
        best = F.max_by(vec, F.struct("_file", "_pos"))
    else:
        best = F.max(vec)
    return df.groupBy(key).agg(best.alias(vec))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin an input that lies in fewer files than there are cores.

    Looks at the list of files only; a large table has many files and is returned untouched.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df.repartition(int(want)) if 0 < len(files) < want else df
