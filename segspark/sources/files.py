"""Reading and writing the file kinds the measures start from."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """One field of a fixed-width record; ``kind`` "N" is a number, anything else text."""

    name: str
    width: int
    start: int
    kind: str = "A"


def layout_fields(layout: DataFrame) -> list[Field]:
    """Field list from a layout table (pos, ddref, field_size, starting_pos, data_type).

    A layout has one row per field of a record, so it is schema, and is collected as such.
    """
    rows = layout.select("pos", "ddref", "field_size", "starting_pos", "data_type").collect()
    return [
        Field(r.ddref, int(r.field_size), int(r.starting_pos), r.data_type)
        for r in sorted(rows, key=lambda r: r.pos)
    ]


def read_fixed_width(spark: SparkSession, path: str, layout: Sequence[Field]) -> DataFrame:
    """Fixed-width text as typed columns; blank fields are NULL, text keeps leading zeros."""
    cols = []
    for f in layout:
        raw = F.trim(F.substring("value", f.start, f.width))
        raw = F.when(raw != "", raw)
        cols.append((raw.cast("double") if f.kind == "N" else raw).alias(f.name))
    return spark.read.text(path).select(*cols)


def write_fixed_width(df: DataFrame, path: str, layout: Sequence[Field]) -> None:
    """Numbers right-aligned, text left-aligned, each padded to its width; a longer value is an error."""
    parts = []
    for f in layout:
        text = F.coalesce(F.col(f.name).cast("string"), F.lit(""))
        padded = F.lpad(text, f.width, " ") if f.kind == "N" else F.rpad(text, f.width, " ")
        wide = F.raise_error(F.concat(F.lit(f"value wider than field {f.name} of {f.width}: "), text))
        parts.append(F.when(F.length(text) > f.width, wide).otherwise(padded))
    df.select(F.concat(*parts).alias("value")).write.mode("overwrite").text(path)


# One-letter column type codes.
TYPE_CODES = {"c": "string", "i": "int", "d": "double", "l": "boolean"}


def schema_from_codes(names: Sequence[str], codes: str) -> T.StructType:
    """Schema from column names and a string of type codes such as ``"cccii"``."""
    if len(names) != len(codes):
        raise ValueError(f"{len(names)} names but {len(codes)} type codes")
    ddl = ", ".join(f"`{n}` {TYPE_CODES[c]}" for n, c in zip(names, codes))
    return T.StructType.fromDDL(ddl)


def numbered_names(prefix: str, first: int, last: int, width: int = 2) -> list[str]:
    """Generated column names such as P0010001 ... P0010071."""
    return [f"{prefix}{i:0{width}d}" for i in range(first, last + 1)]


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType, header: bool, **options: str
) -> DataFrame:
    """Delimited text under a given schema: one pass, no inference, columns pruned at parse."""
    return spark.read.schema(schema).options(header=str(header).lower(), **options).csv(path)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str], fmt: str = "parquet",
                 **options: str) -> DataFrame:
    """Only the named columns; the scan below reads no others."""
    return spark.read.format(fmt).options(**options).load(path).select(*columns)


def read_many(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet",
              schema: T.StructType | None = None, pattern: str | None = None) -> DataFrame:
    """Several files or folders as one scan, optionally only the names that match a glob."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.load(list(paths))


def with_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Human-readable labels as column comments."""
    for name, text in labels.items():
        df = df.withMetadata(name, {"comment": text})
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One folder per value of ``by``.

    The rebalance hint gathers the rows of a folder so that tasks do not each open every
    folder, and lets adaptive execution split a folder that holds most of the rows.
    """
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Partition folders as typed columns; the schema keeps codes like "050" as text."""
    return spark.read.schema(schema).parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True once a write to ``path`` has been committed."""
    try:
        # Planning alone looks for the file; nothing is read.
        spark.read.text(f"{path.rstrip('/')}/_SUCCESS").schema  # noqa: B018
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the result at ``path``, building and writing it first where it is absent.

    Only the commit marker counts as present: what an interrupted write left behind is
    replaced.
    """
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
