"""What several operators of this package share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segspark.session import scratch_dir

#: A word is a longest run of characters outside this class (ASCII white space only).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB from here on, unless the session has settings of its own.

    The defaults (10,000 rows, 64 MB) take several times that much beside the heap, once for every running task.
    """
    for name, default, own in (("Records", "10000", "1000"), ("Bytes", "67108864b", "4m")):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the lineage, survives lost executors."""
    bounded_batches(df.sparkSession)
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_array(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it and wherever a filter is pushed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def running_total(df: DataFrame, group: str | None, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the total of ``value`` over the rows that precede in ``order`` within ``group`` (not null).

    Rows are cut into ranges of (group, order), so a group of any size is spread over many tasks;
    each range is numbered alone and shifted by the totals of the ranges before it. ``order`` must
    be total for the result to be the same in every run; ``df`` should be narrow, as it is written once.
    """
    keys = [group] if group else []
    ranged = store(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = [*keys, "_range"]
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        ranged.groupBy(*ranges).agg(F.sum(value).alias("_sum"))
        .select(*ranges, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(*ranges).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(bases, ranges)
        .withColumn(out, (F.col("_base") + F.col("_in")).cast("long"))
        .drop("_base", "_in", "_range")
    )


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """``make()`` once in a Python worker, which runs many tasks; a lost worker makes its own again."""
    kept = sys.modules.setdefault("_segspark_worker", types.ModuleType("_segspark_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


class BoundedDict(dict):
    """Results of ``make`` by argument; emptied when it holds ``most``, so its memory is bounded."""

    def __init__(self, make: Callable, most: int = 400_000):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def pieces(text: str | None) -> list[str]:
    """The text cut at ASCII white space; may hold empty pieces."""
    if not text:
        return []
    for mark in "\t\n\x0b\f\r":
        text = text.replace(mark, " ")
    return text.split(" ")
