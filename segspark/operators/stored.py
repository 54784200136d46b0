"""Decompositions that are kept as sums and take further leaves by addition."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from segspark.operators import theil
from segspark.sources.build import build_missing


def stored_sums(
    spark: SparkSession, path: str, cells: DataFrame, h: theil.Hierarchy, groups: Sequence[str], part: Sequence[str],
    wanted: DataFrame, focal: str | None = None, with_rest: bool = False,
    cut: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Sums of every part built so far, after building those of ``wanted`` that are not yet at ``path``.

    ``part`` names columns of ``cells`` that cut it into deliveries, such as years or states; ``wanted`` has one row per part.
    All cells of one leaf must come in one part: sums over leaves add up, ``n ln n`` of half a leaf does not. Only cells of missing
    parts are read (``cut(cells, missing)``, a semi-join by default, so partitioned input opens only their folders).
    A part that was built is not looked at again, even where its cells have changed since. One path keeps one
    hierarchy, list of groups and focal group. A null part is a part.
    """
    part = list(part)

    def build(missing: DataFrame) -> DataFrame:
        if cut is not None:
            rows = cut(cells, missing)
        else:
            on = None
            renamed = missing.toDF(*[f"_part{i}" for i in range(len(part))])
            for i, name in enumerate(part):
                same = cells[name].eqNullSafe(renamed[f"_part{i}"])
                on = same if on is None else on & same
            rows = cells.join(renamed, on, "left_semi")
        return sums(rows)

    def sums(rows: DataFrame) -> DataFrame:
        outside = [c for c in part if c not in h.scope_cols]
        return theil.mid_sums(rows, h, groups, focal, with_rest, part=outside)

    return build_missing(spark, path, wanted.select(*part), part, sums(cells).schema, build)


def decompose_stored(
    sums: DataFrame, h: theil.Hierarchy, groups: Sequence[str], focal: str | None = None, with_rest: bool = False,
    guard_total: bool = False,
) -> DataFrame:
    """The measures of ``theil.decompose`` from stored sums; no cell is read."""
    added = theil.added_sums(sums, h, groups, focal, with_rest)
    return theil.from_sums(added, h, groups, focal, with_rest, guard_total)
