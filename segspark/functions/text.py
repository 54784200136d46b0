"""String helpers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def invert(mapping: Mapping[str, str]) -> dict[str, str]:
    """Swap keys and values; a repeated value is an error, as it would lose a column."""
    out = {v: k for k, v in mapping.items()}
    if len(out) != len(mapping):
        raise ValueError("values are not unique")
    return out


def pad_code(col: Column, width: int) -> Column:
    """Zeros to the left up to ``width``; a longer code stays whole (``lpad`` would cut it)."""
    text = col.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def replace_first(col: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only (``regexp_replace`` replaces all of them)."""
    return F.regexp_replace(col, f"^((?s:.*?))(?:{pattern})", "$1" + replacement)


def squash_suffix(col: Column, suffixes: Sequence[str]) -> Column:
    """Drop the first occurrence of each literal suffix, one after the other."""
    for suffix in suffixes:
        col = replace_first(col, re.escape(suffix), "")
    return col
