"""Ranks, running sums and row ids that do not gather a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.session import scratch_dir


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group.

    Filtering on ``row_number() = 1`` lets Spark cut every group to one row per task before
    the shuffle, so a large group is never gathered.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def max_with_ties(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All rows that reach the maximum of their group; a group without a value keeps all its rows.

    The maxima are partial aggregates and the rows meet them in a join, whose skewed partitions Spark
    splits: any number of ties may share a key.
    """
    best = df.groupBy(*keys).agg(F.max(value).alias("_best")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_best")
    same = F.col(value).eqNullSafe(F.col("_best"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(best, same, "left_semi")


def share_of_total(df: DataFrame, keys: Sequence[str], shares: dict[str, str], small_groups: bool = False) -> DataFrame:
    """``{new column: value column}``: each value over the sum of its group.

    Totals are aggregated with map-side sums and joined back, instead of a window that would
    put a whole group into one task. ``small_groups`` says that no group is large, as where ``keys`` name a leaf and its
    rows are its groups of people: then a window, which reads the input once.
    """
    if small_groups:
        w = Window.partitionBy(*keys)
        return df.withColumns({
            o: F.try_divide(F.col(v).cast("double"), F.sum(v).over(w).cast("double")) for o, v in shares.items()})
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(f"_tot_{o}") for o, v in shares.items()])
    left, right = df.alias("_l"), totals.alias("_r")
    cond = None
    for k in keys:
        c = F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}"))
        cond = c if cond is None else cond & c
    joined = left.join(right, cond, "left")
    return joined.select(
        "_l.*",
        *[
            F.try_divide(F.col(f"_l.{v}").cast("double"), F.col(f"_r._tot_{o}").cast("double")).alias(o)
            for o, v in shares.items()
        ],
    )


def layout_mismatches(layout: DataFrame, file_keys: Sequence[str], order: Sequence[str],
                      size: str, start: str) -> DataFrame:
    """Fields whose declared start differs from 1 + the widths before them.

    The window runs over the fields of one record layout.
    """
    w = Window.partitionBy(*file_keys).orderBy(*order)
    running = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = layout.withColumn("end_pos", running)
    rows = rows.withColumn("expected_pos", F.coalesce(F.lag("end_pos").over(w) + 1, F.lit(1)))
    return rows.where(F.col("expected_pos") != F.col(start))


def dense_row_id(df: DataFrame, key: str, out: str = "id", buckets: int | None = None) -> DataFrame:
    """``1..n`` in the order of a unique key, null first, without a window over the whole table.

    Spark cuts the rows into ranges of the key; they are written once to the shared folder with the number of
    their range, numbered inside it, and shifted by the rows of the ranges before. The borders of the ranges only
    balance the work, any borders give the same ids. ``buckets`` sets the number of ranges, else it is the session's
    number of shuffle partitions.
    """
    spark = df.sparkSession
    order = F.col(key).asc_nulls_first()
    ranged = df.repartitionByRange(buckets, order) if buckets else df.repartitionByRange(order)
    path = scratch_dir(spark, "ranges")
    ranged.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    # One row per range reaches this window.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    joined = numbered.join(offsets, F.col("_part") == F.col("_of"))
    return joined.withColumn(out, (F.col("_rn") + F.col("_off")).cast("long")).select(*df.columns, out)
