"""Renaming, recoding and long/wide reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: Sequence[str], columns: Mapping[str, str] | Sequence[str],
            name: str = "name", value: str = "value") -> DataFrame:
    """Columns to rows; a mapping gives the label each column becomes."""
    if isinstance(columns, Mapping):
        df = df.select(*ids, *[F.col(c).alias(label) for label, c in columns.items()])
        columns = list(columns)
    return df.unpivot(list(ids), list(columns), name, value)


def to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str,
            labels: Sequence[str], unique: bool = True) -> DataFrame:
    """Rows to one column per label, as conditional aggregates in one shuffle.

    Two rows for one cell are an error unless ``unique`` is off; then they are summed.
    """
    aggs = []
    for label in labels:
        cell = F.when(F.col(name) == label, F.col(value))
        if unique:
            twice = F.count(F.when(F.col(name) == label, 1)) > 1
            out = F.when(twice, F.raise_error(F.lit(f"more than one row for {label}"))).otherwise(F.max(cell))
        else:
            out = F.sum(cell)
        aggs.append(out.alias(label))
    return df.groupBy(*keys).agg(*aggs)


def recode(col: Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Exact-value dictionary as one literal map lookup."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col)
    return found if default is None else F.coalesce(found, default)


def recode_prefix(col: Column, length: int, mapping: Mapping[str, str]) -> Column:
    return recode(F.substring(col, 1, length), mapping)


def collapse(col: Column, classes: Mapping[str, Sequence[str]]) -> Column:
    """Several labels to one class each; labels of no class become NULL."""
    return recode(col, {v: label for label, values in classes.items() for v in values})


def focal_or_rest(col: Column, focal: str, rest: str) -> Column:
    return F.when(col == focal, F.lit(focal)).otherwise(F.lit(rest))


def row_sum(columns: Sequence[str]) -> Column:
    """Sum across columns; NULL if any of them is."""
    return reduce(add, [F.col(c) for c in columns])


def build_keys(df: DataFrame, parts: Mapping[str, Sequence[str]]) -> DataFrame:
    """Concatenated unique keys; all of them are made from the columns as they were."""
    return df.withColumns({
        out: F.concat(*[F.col(c).cast("string") for c in cols]) for out, cols in parts.items()
    })


def split_key(df: DataFrame, key: str, parts: Mapping[str, tuple[int, int]]) -> DataFrame:
    """Cut a code into parts given as (first, last) positions, counted from 1, both inclusive."""
    return df.withColumns({
        out: F.substring(key, first, last - first + 1) for out, (first, last) in parts.items()
    })


def both_zero_dropped(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows counted by at least one source."""
    return df.where(~((F.col(a) == 0) & (F.col(b) == 0)))


def totals_differ(df: DataFrame, total: str, parts: Sequence[str]) -> DataFrame:
    """Rows whose parts do not add up to their total."""
    return df.where(F.col(total) != row_sum(parts))


def metric_panel(decomp: DataFrame, keys: Sequence[str], metrics: Mapping[str, str],
                 sources: Sequence[str]) -> DataFrame:
    """One row per key and metric with a column per source."""
    long = to_long(decomp, [*keys, "name"], metrics, "metric", "value")
    return to_wide(long, [*keys, "metric"], "name", "value", sources)
