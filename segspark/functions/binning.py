"""Right-closed bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def right_closed_bin(num: Column, den: Column, bins: int) -> Column:
    """Bin ``1..bins`` of the share num/den over ((k-1)/bins, k/bins].

    Works on the integer pair: scaling an already divided share puts values such as 0.07 on
    the wrong side of an edge. Shares at or below 0 go to the first bin, NULL stays NULL.
    """
    k = F.ceil(F.try_divide((num * F.lit(bins)).cast("double"), den.cast("double")))
    return F.when(k.isNotNull(), F.least(F.lit(bins), F.greatest(F.lit(1), k)).cast("int"))


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin ``1..bins`` of equal width over [low, high], right-closed, lowest edge included."""
    k = F.ceil(F.try_divide((x - low) * F.lit(float(bins)), high - low))
    inside = F.least(F.lit(bins), F.greatest(F.lit(1), F.coalesce(k, F.lit(1))))
    return F.when(x.isNotNull(), inside.cast("int"))
