"""Joins to dimensions and keys.

Plain equi-joins: Spark broadcasts a side only below its size threshold, measured at run time,
and otherwise shuffles with skewed partitions split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.functions import pad_code


def record_geography(records: DataFrame, geography: DataFrame, key: str, width: int) -> DataFrame:
    """Data records with the geography of the same record number.

    The geography file holds the number as a number, the data file as text, zero-padded to ``width`` digits
    and longer where the number is.
    Records without a geography of the chosen level drop out.
    """
    padded = pad_code(F.col(key).cast("long"), width)
    return records.join(geography.withColumn(key, padded), key, "inner")


def membership_flag(df: DataFrame, key: str, members: DataFrame, out: str) -> DataFrame:
    """``"1"`` where the key occurs among ``members``, else ``"0"``; never NULL."""
    ids = members.select(F.col(key)).distinct().withColumn("_in", F.lit(1))
    joined = df.join(ids, key, "left")
    return joined.withColumn(out, F.coalesce(F.col("_in"), F.lit(0)).cast("string")).drop("_in")


def attach_distinct(df: DataFrame, dim: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of a dimension after removing its repeated rows, so no row is multiplied."""
    return df.join(dim.select(*on, *columns).distinct(), list(on), "left")


def assign_place(df: DataFrame, unit_place: DataFrame, unit: str, place: str,
                 missing: str = "No Place") -> DataFrame:
    """The place of every unit, or the label for units outside all places."""
    joined = df.join(unit_place.select(unit, place), unit, "left")
    return joined.withColumn(place, F.coalesce(F.col(place), F.lit(missing)))


def attach_literal(df: DataFrame, key: str, mapping: Mapping[str, str], out: str) -> DataFrame:
    """A dimension given in code, as a join; Spark broadcasts it if it is small."""
    spark = df.sparkSession
    dim = spark.createDataFrame(list(mapping.items()), f"`{key}` string, `{out}` string")
    return df.join(dim, key, "left")
