"""Reproducible, partition-independent sampling and splitting.

Every draw orders rows by ``md5('seed:...:row_id')`` (ties: row_id). Exact per-group
quotas ("the first k rows of each class in hash order") are found without a window over
a whole group: rows are counted per (group, 4-hex-digit hash prefix) -- at most 65,536
buckets per group, a small table -- the cumulative counts locate the one boundary bucket
per group, a row for each group that is broadcast, and only the rows of that bucket (about n/65,536) are ranked with a window.
Buckets are uniform because the hash is, so a class holding most rows is still split
over 65,536 buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.functions.scores import draw_key

PREFIX_HEX = 4


def prefix_split(df: DataFrame, col: str, prefix: str, out: str = "is_prefix") -> DataFrame:
    """lower(col) starts with prefix; NULL counts as false (two complementary parts)."""
    return df.withColumn(out, F.coalesce(F.lower(F.col(col)).startswith(prefix.lower()), F.lit(False)))


def quota_select(df: DataFrame, order_key: str, quota: Callable[[Column], Column],
                 group_cols: list[str] | tuple = (), id_col: str = "row_id",
                 out: str = "selected") -> DataFrame:
    """Mark the first ``quota(n_group)`` rows of each group in (order_key, id) order.

    ``order_key`` is a lowercase hex string column (an md5). Adds boolean ``out``.
    """
    g = list(group_cols)
    d = df.withColumn("_bk", F.substring(order_key, 1, PREFIX_HEX))
    per = d.groupBy(*g, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    wg = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    per = (per.withColumn("_before", F.coalesce(F.sum("_c").over(wg.orderBy("_bk").rowsBetween(
                Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("_n", F.sum("_c").over(wg))
              .withColumn("_k", quota(F.col("_n")).cast("bigint"))
              .withColumn("_state", F.when(F.col("_before") + F.col("_c") <= F.col("_k"), F.lit(1))
                                   .when(F.col("_before") >= F.col("_k"), F.lit(0))
                                   .otherwise(F.lit(2))))
    # a group's buckets are taken up to one and at most one is divided: a row for each group tells it, so no row of df is shuffled
    cut = (per.groupBy(*g).agg(F.max(F.when(F.col("_state") == 1, F.col("_bk"))).alias("_last"), F.max(F.when(F.col("_state") == 2, F.col("_bk"))).alias("_edge"),
                               F.max(F.when(F.col("_state") == 2, F.col("_k") - F.col("_before"))).alias("_need")))
    j = (d.join(F.broadcast(cut), g) if g else d.crossJoin(F.broadcast(cut))).where(F.col("_bk").isNotNull())
    on_edge = F.coalesce(F.col("_bk") == F.col("_edge"), F.lit(False))
    settled = j.where(~on_edge).withColumn(out, F.coalesce(F.col("_bk") <= F.col("_last"), F.lit(False)))
    wb = Window.partitionBy(*g, "_bk").orderBy(order_key, id_col)
    edge = (j.where(on_edge)
             .withColumn(out, F.row_number().over(wb) <= F.col("_need")))
    return settled.unionByName(edge).drop("_bk", "_last", "_edge", "_need")


def stratified_split(df: DataFrame, label: str = "label", test_fraction: float = 0.2, seed: int = 0,
                     id_col: str = "row_id", out: str = "is_test") -> DataFrame:
    """Per class, round(test_fraction * n_class) rows go to test (seeded hash order)."""
    d = df.withColumn("_h", draw_key(id_col, seed))
    r = quota_select(d, "_h", lambda n: F.round(n * F.lit(test_fraction)), [label], id_col, out)
    return r.drop("_h")


def shuffle_split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42, id_col: str = "row_id",
                  out: str = "is_test") -> DataFrame:
    """Shuffled split: floor((1-f) n) rows train, the rest test, in seeded hash order."""
    d = df.withColumn("_h", draw_key(id_col, seed))
    train = quota_select(d, "_h", lambda n: F.floor(n * F.lit(1.0 - test_fraction)), [], id_col, "_train")
    return train.withColumn(out, ~F.col("_train")).drop("_train", "_h")


def _by_cut(data: DataFrame, split: DataFrame, seed: int, group_cols, test_first: bool, id_col: str, flag: str) -> tuple[DataFrame, bool]:
    """(``data`` with ``_test``, the side of each row by the last place of its group's first stretch; whether repeated ids lie on both sides)."""
    spark = data.sparkSession
    place = F.struct(draw_key(id_col, seed).alias("h"), F.col(id_col).alias("id"))
    first = F.col(flag) if test_first else ~F.col(flag)
    cuts = split.where(first).groupBy(*[F.col(g).alias(f"_cut_{g}") for g in group_cols]).agg(F.max(place).alias("_cut"))
    cuts = spark.createDataFrame(cuts.collect(), cuts.schema)  # a row for each group
    same = F.lit(True)
    for g in group_cols:
        same = same & F.col(g).eqNullSafe(F.col(f"_cut_{g}"))

    def told(df: DataFrame) -> DataFrame:
        inside = F.coalesce(place <= F.col("_cut"), F.lit(False))
        return df.join(F.broadcast(cuts), same, "left").withColumn("_test", inside if test_first else ~inside).drop(*cuts.columns)

    sides = told(split).where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(flag).alias("held"), F.min("_test").alias("least"), F.max("_test").alias("most"))
    return told(data), not sides.where((F.col("least") != F.col("held")) | (F.col("most") != F.col("held"))).isEmpty()


def divide(data: DataFrame, split: DataFrame, seed: int, group_cols: list[str] | tuple = (), test_first: bool = True,
           id_col: str = "row_id", flag: str = "is_test") -> tuple[DataFrame, DataFrame]:
    """(rows whose id is not in the test part, rows whose id is in it) of a table of any width.

    A split takes a first stretch of each group in draw order (the test part of ``stratified_split``, the other one of
    ``shuffle_split``), so the last place of that stretch tells the side of every row: a filter by one row for each group, and the
    wide rows are not shuffled. Where repeated ids lie on both sides of it the rows are joined to the test part's ids instead.
    """
    told, apart = _by_cut(data, split, seed, group_cols, test_first, id_col, flag)
    if apart:
        held = split.where(flag).select(id_col)
        return data.join(held, id_col, "left_anti"), data.join(held, id_col, "left_semi")
    null = F.col(id_col).isNull()  # as in a join: an empty id is in no list
    return told.where(~F.col("_test") | null).drop("_test"), told.where(F.col("_test") & ~null).drop("_test")


def mark(data: DataFrame, split: DataFrame, seed: int, out: str, test_first: bool = False, id_col: str = "row_id", flag: str = "is_test") -> DataFrame:
    """``data`` joined to the flags of a split without groups, as column ``out``, by the cut of ``divide``; where ids repeat the rows are joined."""
    told, _ = _by_cut(data, split, seed, (), test_first, id_col, flag)
    if split.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        return told.where(F.col(id_col).isNotNull()).withColumnRenamed("_test", out)
    return data.join(split.select(id_col, F.col(flag).alias(out)), id_col)


def balanced_seed(df: DataFrame, seed_size: int = 100, seed: int = 0, label: str = "label",
                  id_col: str = "row_id", out: str = "selected") -> DataFrame:
    """Cold start: seed_size // 2 rows per class without replacement; fails if a class is short."""
    half = int(seed_size) // 2

    def quota(n: Column) -> Column:
        return F.when(n >= half, F.lit(half)).otherwise(
            F.raise_error(F.concat(F.lit("class too small for the balanced seed: "), n.cast("string"))))

    d = df.withColumn("_h", draw_key(id_col, seed, "seed"))
    return quota_select(d, "_h", quota, [label], id_col, out).drop("_h")


def subsample(df: DataFrame, n_max: int = 5000, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """min(n_max, n) rows without replacement (distributed top-k on the hash)."""
    return (df.withColumn("_h", draw_key(id_col, seed, "sub"))
              .orderBy("_h", id_col).limit(int(n_max)).drop("_h"))
