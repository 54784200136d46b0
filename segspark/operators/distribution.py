"""Quantiles, histograms and densities of a measure, at a cost that does not depend on groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.functions.binning import equal_width_bin


#: Steps of the sketch that narrows a bracket, and its accuracy: a rank is known to a quarter of a step.
STEPS, ACCURACY = 500, 2_000


def _met(known: DataFrame, by: Sequence[str], brackets: DataFrame) -> DataFrame:
    """Rows against the brackets of their group; what lies above a bracket is dropped."""
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    return known.join(brackets, same).where(F.col("_x") <= F.col("_hi"))


def quantile_brackets(known: DataFrame, by: Sequence[str], probs: Sequence[float], limit: int) -> DataFrame:
    """Values ``_lo`` and ``_hi`` around the quantile ``_p`` of ``_x`` in every group (``_k0``, ...) of ``_n`` rows.

    A bracket starts as the range of its group and is narrowed in rounds. Each round sketches the rows inside the
    brackets (partial aggregates) and keeps the steps next to the wanted rank: at most 5 in ``STEPS`` of the rows,
    whatever their distribution, and rows that equal an end. The number of rounds follows from the largest group, so that
    in the end at most ``limit`` rows, but for those that equal an end, are inside. With ``limit`` rows or fewer in every group there
    is no round.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    sizes = known.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys)]).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    rounds, most = 0, sizes.agg(F.max("_n")).first()[0] or 0
    while most > limit:
        most, rounds = most * 5 // STEPS, rounds + 1
    brackets = sizes.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in probs])))
    pos = F.lit(1.0) + (F.col("_n") - 1) * F.col("_p")
    x = F.col("_x")
    for _ in range(rounds):
        within = F.when(x >= F.col("_lo"), x)
        steps = F.percentile_approx(within, F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]), ACCURACY)
        inside = _met(known, by, brackets).groupBy(*keys, "_p", "_n", "_lo", "_hi").agg(
            F.count(F.when(x < F.col("_lo"), 1)).alias("_below"), F.count(within).alias("_in"), steps.alias("_s"))
        at = lambda rank: (rank - F.col("_below")) * STEPS / F.col("_in")
        low = F.greatest(F.floor(at(F.floor(pos))) - 1, F.lit(0)).cast("int")
        high = F.least(F.ceil(at(F.ceil(pos))) + 1, F.lit(STEPS)).cast("int")
        # The first and the last step are the ends of the bracket, whatever the sketch says.
        brackets = inside.select(
            *keys, "_p", "_n", F.when(low == 0, F.col("_lo")).otherwise(F.get("_s", low)).alias("_lo"),
            F.when(high == STEPS, F.col("_hi")).otherwise(F.get("_s", high)).alias("_hi"))
    return brackets


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    limit: int = 100_000) -> DataFrame:
    """Interpolated quantiles (position ``1 + (n-1) p``) per group, exact without sorting a group.

    Only the distinct values inside the last bracket of a quantile (``quantile_brackets``) are put in order, about ``limit`` at most;
    rows below it are counted. Null values and groups without a value are left out; a null key is a group.
    """
    by, probs = list(by), [float(p) for p in probs]
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    if not by:
        known, by = known.withColumn("_all", F.lit(0)), ["_all"]
    keys = [f"_k{i}" for i in range(len(by))]
    brackets = quantile_brackets(known, by, probs, limit)
    # The lowest entry of a bracket, without a value, stands for all rows below it.
    counted = _met(known, by, brackets).groupBy(*keys, "_p", "_n", F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys, "_p", "_n").orderBy(F.col("_v").asc_nulls_first())
    counted = counted.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pos = F.lit(1.0) + (F.col("_n") - 1) * F.col("_p")
    first = F.col("_upto") - F.col("_c") + 1

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= F.col("_upto")), F.col("_v")))

    picked = counted.groupBy(*keys, "_p", "_n").agg(at_rank(F.floor(pos)).alias("_a"), at_rank(F.ceil(pos)).alias("_b"))
    frac = pos - F.floor(pos)
    return picked.select(
        *[F.col(k).alias(b) for b, k in zip(by, keys) if b != "_all"], F.col("_p").alias("p"),
        (F.col("_a") + (F.col("_b") - F.col("_a")) * frac).alias("quantile"))


def bandwidth(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rule-of-thumb kernel bandwidth: 0.9 min(sd, IQR / 1.34) n^-0.2 per group."""
    by = list(by)
    quart = exact_quantiles(df, by, value, [0.25, 0.75])
    iqr = quart.groupBy(*by).agg(
        (F.max(F.when(F.col("p") == 0.75, F.col("quantile")))
         - F.max(F.when(F.col("p") == 0.25, F.col("quantile")))).alias("_iqr")
    )
    base = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.stddev_samp(value).alias("_sd"), F.count(F.lit(1)).alias("_n"))
    spread = F.least(F.col("_sd"), F.col("_iqr") / 1.34)
    # A zero IQR falls back on the standard deviation, and a constant on 1.
    spread = F.when(spread > 0, spread).when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    return base.join(iqr, by).select(
        *by, "_n", (F.lit(0.9) * spread * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("bw")
    )


def _with_range(df: DataFrame, value: str) -> DataFrame:
    """Smallest and largest value of the column as ``_lo`` and ``_hi``: one scalar subquery."""
    ends = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")))
    return df.withColumn("_e", ends.scalar()).withColumns({"_lo": F.col("_e.lo"), "_hi": F.col("_e.hi")}).drop("_e")


def density_curve(df: DataFrame, by: str, value: str, points: int = 512, mass_points: int = 1024) -> DataFrame:
    """Gaussian kernel density of ``value`` per group on a common grid of ``points``.

    Every row puts its weight on the two nearest of ``mass_points`` grid positions (linear
    binning), so the kernel runs over a table of fixed size instead of over rows x points.
    The range, the spread and the masses are separate passes: give a written table where
    ``df`` is expensive.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(by), F.col(value).cast("double").alias("_x"))
    placed = _with_range(known, "_x")
    step = (F.col("_hi") - F.col("_lo")) / float(mass_points - 1)
    at = F.coalesce(F.try_divide(F.col("_x") - F.col("_lo"), step), F.lit(0.0))
    left = F.least(F.floor(at), F.lit(mass_points - 2))
    two = F.array(
        F.struct(left.alias("g"), (F.lit(1.0) - (at - left)).alias("m")),
        F.struct((left + 1).alias("g"), (at - left).alias("m")),
    )
    mass = placed.withColumn("_e", F.explode(two)).groupBy(by, "_lo", "_hi", F.col("_e.g").alias("_g")).agg(
        F.sum("_e.m").alias("_m")
    )
    # From here on at most mass_points rows per group.
    grid = mass.join(bandwidth(known, [by], "_x"), by)
    grid = grid.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / float(points - 1)
    centre = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_g") / float(mass_points - 1)
    z = (x - centre) / F.col("bw")
    kernel = F.exp(F.lit(-0.5) * z * z) / (F.col("bw") * math.sqrt(2.0 * math.pi))
    return grid.groupBy(by, "point").agg(
        F.max(x).alias("x"), (F.sum(F.col("_m") * kernel) / F.max("_n")).alias("density")
    )


def equal_width_bins(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Bin number of every row over the range of the whole column (a scalar subquery)."""
    return _with_range(df, value).withColumn(
        out, equal_width_bin(F.col(value).cast("double"), F.col("_lo"), F.col("_hi"), bins)
    ).drop("_lo", "_hi")


def histogram(df: DataFrame, by: Sequence[str], value: str, bins: int = 30,
              per_group: bool = False) -> DataFrame:
    """Row counts per group and equal-width bin; ``per_group`` gives each group its own range."""
    known = df.where(F.col(value).isNotNull())
    if not per_group:
        binned = equal_width_bins(known, value, bins)
    else:
        ends = known.groupBy(*by).agg(
            F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
        binned = known.join(ends, list(by)).withColumn(
            "bin", equal_width_bin(F.col(value).cast("double"), F.col("_lo"), F.col("_hi"), bins))
    return binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
