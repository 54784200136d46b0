"""Builds that go on where they stopped, and audits that ride along with a write."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segspark.session import scratch_dir
from segspark.sources.files import is_complete, read_partitioned


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def build_missing(spark: SparkSession, path: str, wanted: DataFrame, keys: Sequence[str], schema: T.StructType,
                  build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of every built key, after building those of ``wanted`` that are not yet there.

    ``build`` gets a table of the missing keys and returns their rows in ``schema``, key columns included; it is not called
    when nothing is missing. Rows go to one folder per key (``path/data``), then the keys to a list (``path/built``).
    Only listed keys count as present: what a killed write left behind is neither read nor kept, as the next call replaces those
    folders whole. A wanted key without rows is listed, too, so it is not tried again. A null key is a key. Two calls
    at a time must not want the same keys.
    """
    keys = list(keys)
    data, built = f"{path.rstrip('/')}/data", f"{path.rstrip('/')}/built"
    key_schema = T.StructType([schema[k] for k in keys])
    if not is_complete(spark, built):
        spark.createDataFrame([], schema).write.mode("overwrite").partitionBy(*keys).parquet(data)
        spark.createDataFrame([], key_schema).write.mode("overwrite").parquet(built)
    listed = spark.read.schema(key_schema).parquet(built)
    cast = [F.col(k).cast(key_schema[k].dataType).alias(k) for k in keys]
    missing = wanted.select(*cast).distinct().alias("w").join(listed.alias("l"), _same("w", "l", keys), "left_anti")
    # Written first: the list grows while it is read otherwise.
    todo = scratch_dir(spark, "missing")
    missing.write.parquet(todo)
    missing = spark.read.schema(key_schema).parquet(todo)
    if not missing.isEmpty():
        rows = build(missing).select(*schema.names)
        rows.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(data)
        missing.write.mode("append").parquet(built)
    rows, listed = read_partitioned(spark, data, schema), spark.read.schema(key_schema).parquet(built)
    return rows.alias("d").join(listed.distinct().alias("l"), _same("d", "l", keys), "left_semi").select(*schema.names)


def write_audited(df: DataFrame, path: str, failing: Mapping[str, Column], by: Sequence[str] = ()) -> dict[str, int]:
    """Write ``df`` to parquet and count, in the same pass, all ``rows`` and those that meet each condition of ``failing``.

    The counts are observed metrics of the write: the table is neither read again nor planned twice. A condition that is
    null does not count as met.
    """
    if "rows" in failing:
        raise ValueError("'rows' names the count of all rows")
    seen = Observation()
    counts = [F.count(F.when(cond, 1)).alias(name) for name, cond in failing.items()]
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    watched.write.mode("overwrite").partitionBy(*by).parquet(path)
    return {name: int(n) for name, n in seen.get.items()}
