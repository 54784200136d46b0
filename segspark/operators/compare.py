"""What changes between two sources or two years."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from segspark.functions.numeric import safe_div, xlnx
from segspark.operators.reshape import to_long, to_wide

# The measures of a decomposition, in output order.
MEASURES = ["Hw", "H", "totalE", "Hb", "Pb", "Hbg", "Pbg"]


def paired_difference(df: DataFrame, keys: Sequence[str], label: str, value: str,
                      first: object, second: object, out: str) -> DataFrame:
    """``second - first`` per group; NULL if one is undefined, no row if one is missing."""
    pick = lambda v: F.max(F.when(F.col(label) == v, F.col(value)))
    have = lambda v: F.max((F.col(label) == v).cast("int"))
    rows = df.where(F.col(label).isin(first, second)).groupBy(*keys).agg(
        (pick(second) - pick(first)).alias(out), (have(first) + have(second)).alias("_both")
    )
    return rows.where(F.col("_both") == 2).drop("_both")


def measure_errors(decomp: DataFrame, keys: Sequence[str], measures: Sequence[str] = MEASURES,
                   first: str = "CENSUS", second: str = "DP") -> DataFrame:
    """Error of every measure (second source minus first), one row per key."""
    return decomp.where(F.col("name").isin(first, second)).groupBy(*keys).agg(*[
        (F.max(F.when(F.col("name") == second, F.col(m)))
         - F.max(F.when(F.col("name") == first, F.col(m)))).alias(m)
        for m in measures
    ])


def change_from_baseline(base: DataFrame, later: DataFrame, keys: Sequence[str],
                         measures: Sequence[str], base_year: int, later_year: int,
                         sources: Sequence[str] = ("DP", "CENSUS")) -> DataFrame:
    """Change of every measure since a one-source baseline, as each later source shows it.

    Both tables are stacked and meet in one aggregate; a column per later source. Where both years come from one
    table, ``change_between_years`` plans it once.
    """
    both = base.withColumn("_y", F.lit(base_year)).unionByName(later.withColumn("_y", F.lit(later_year)), allowMissingColumns=True)
    return change_between_years(both, "_y", keys, measures, base_year, later_year, sources)


def change_between_years(df: DataFrame, year: str, keys: Sequence[str], measures: Sequence[str],
                         base_year: int, later_year: int, sources: Sequence[str] = ("DP", "CENSUS"),
                         base_source: str | None = None) -> DataFrame:
    """As ``change_from_baseline``, from one table of both years: read and planned once, one aggregate.

    ``base_source`` names the source (column ``name``) of the first year; None takes the year's only one.
    """
    long = to_long(df, [year, *keys, "name"], list(measures), "metric", "value")
    first = F.col(year) == base_year
    if base_source is not None:
        first = first & (F.col("name") == base_source)
    at_base, n_base = F.max(F.when(first, F.col("value"))), F.count(F.when(first, 1))
    cols, counts = [], []
    for s in sources:
        mine = (F.col(year) == later_year) & (F.col("name") == s)
        cols.append((F.max(F.when(mine, F.col("value"))) - at_base).alias(s))
        counts.append(F.count(F.when(mine, 1)))
    rows = long.groupBy(*keys, "metric").agg(*cols, n_base.alias("_n0"), counts[0].alias("_n1"))
    # As with a left join, the first source decides which rows exist.
    return rows.where((F.col("_n0") > 0) & (F.col("_n1") > 0)).drop("_n0", "_n1")


def increase_summary(changes: DataFrame, sources: Sequence[str] = ("DP", "CENSUS")) -> DataFrame:
    """Mean change in points and share of increases; no change counts as half an increase."""
    long = to_long(changes, [], list(sources))
    return long.groupBy("name").agg(
        F.round(F.avg(F.col("value") * 100.0), 2).alias("mu"),
        F.avg((F.signum("value") + 1.0) / 0.02).alias("pplus"),
    )


def type_means(df: DataFrame, keys: Sequence[str], value: str, complement: str,
               label: str | None = None) -> DataFrame:
    """Mean of a share per key and its complement to 1, as rows (metric, value)."""
    means = df.groupBy(*keys).agg(F.avg(value).alias(label or value))
    means = means.withColumn(complement, F.lit(1.0) - F.col(label or value))
    return to_long(means, list(keys), [label or value, complement], "metric", "value")


def numeric_means(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of every numeric column that is not a key, undefined values left out."""
    cols = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in keys]
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def erased(first: Column, second: Column) -> Column:
    """Counted by the first source, zero in the second."""
    return (second == 0) & (first != 0)


def erasure_creation(cells: DataFrame, by: Sequence[str], first: str, second: str) -> DataFrame:
    """Rates and counts of cells the second source empties, and of cells it makes up."""
    a, b = F.col(first), F.col(second)
    gone, made, diff = erased(a, b), erased(b, a), b - a
    return cells.groupBy(*by).agg(
        F.avg(gone.cast("int")).alias("erasure_rate"),
        F.sum(F.when(gone, diff).otherwise(0)).alias("erased_count"),
        F.avg(made.cast("int")).alias("creation_rate"),
        F.sum(F.when(made, diff).otherwise(0)).alias("created_count"),
    )


def metro_covariates(cells: DataFrame, by: Sequence[str], leaf: Sequence[str], group: str,
                     value: str, focal: str, shares: Mapping[str, str]) -> DataFrame:
    """Size, number of leaves, rest-to-focal ratio and group shares of every scope.

    Leaves are counted by a second aggregate over leaf rows, not by a distinct set per scope.
    """
    n = F.col(value)
    sums = [F.sum(F.when(F.col(group) == g, n).otherwise(0)).alias(f"_{out}") for out, g in shares.items()]
    per_leaf = cells.groupBy(*by, *leaf).agg(
        F.sum(n).alias("_t"), F.sum(F.when(F.col(group) == focal, n).otherwise(0)).alias("_f"), *sums)
    rows = per_leaf.groupBy(*by).agg(
        F.sum("_t").alias("_t"), F.sum("_f").alias("_f"), F.count(F.lit(1)).alias("block_count"),
        *[F.sum(f"_{out}").alias(f"_{out}") for out in shares],
    )
    return rows.select(
        *by, F.col("_t").alias("total_pop"), safe_div(F.col("_t") - F.col("_f"), F.col("_f")).alias("nw_w_ratio"),
        "block_count", *[safe_div(F.col(f"_{out}"), F.col("_t")).alias(out) for out in shares],
    )


def share_entropy(shares: Sequence[Column]) -> Column:
    """``-sum p ln p``, undefined as soon as one share is zero."""
    out = F.lit(0.0)
    ok = F.lit(True)
    for p in shares:
        out = out - xlnx(p)
        ok = ok & (p > 0)
    return F.when(ok, out)


def local_entropy(cells: DataFrame, unit: Sequence[str], group: str, groups: Sequence[str],
                  sources: Mapping[str, str], pop: str | None = None) -> DataFrame:
    """Entropy of each unit under every source, side by side, 0 where a source counts nobody."""
    from segspark.functions.numeric import mass_text
    from segspark.operators.theil import leaf_vectors

    values = list(sources.values())
    extra = [F.sum(F.when(F.col(group).isin(list(groups)), F.col(pop))).alias("Pop")] if pop else []
    rows = leaf_vectors(cells.where(F.col(group).isin(list(groups))), unit, group, groups, values, extra)
    out = []
    for s, label in enumerate(sources):
        cols = [f"_n{i}_{s}" for i in range(len(groups))]
        total = " + ".join(f"coalesce({c}, 0)" for c in cols)
        out.append(F.expr(f"coalesce(try_divide({mass_text(cols)}, {total}), 0D)").alias(label))
    return rows.select(*unit, *out, *(["Pop"] if pop else []))


def binomial_counts(cells: DataFrame, unit: Sequence[str], group: str, classes: Sequence[str],
                    first: str, second: str) -> DataFrame:
    """Successes, trials and shares per unit for every class, under both sources.

    One aggregate makes a row per unit with a column per class; the classes become rows after
    it, so the input is not repeated per class.
    """
    aggs = [F.sum(second).alias("dpN"), F.sum(first).alias("cN")]
    for i, g in enumerate(classes):
        hit = F.col(group) == g
        aggs += [F.sum(F.when(hit, F.col(second)).otherwise(0)).alias(f"_d{i}"),
                 F.sum(F.when(hit, F.col(first)).otherwise(0)).alias(f"_c{i}")]
    rows = cells.groupBy(*unit).agg(*aggs).where(~((F.col("dpN") == 0) & (F.col("cN") == 0)))
    each = F.array(*[
        F.struct(F.lit(g).alias("eth"), F.col(f"_d{i}").alias("dpY"), F.col(f"_c{i}").alias("cY"))
        for i, g in enumerate(classes)
    ])
    rows = rows.withColumn("_e", F.explode(each)).select(*unit, "_e.*", "dpN", "cN")
    return rows.withColumns({
        "cP": safe_div(F.col("cY"), F.col("cN")), "dpP": safe_div(F.col("dpY"), F.col("dpN")),
    })


def growth_frame(cells: DataFrame, unit: Sequence[str], group: str, focal: str,
                 first: str, second: str) -> DataFrame:
    """Population of each unit under both sources, its change and the share of the focal group.

    A unit without a row for the focal group has an unknown share, not a share of 0.
    """
    rows = cells.groupBy(*unit).agg(
        F.sum(first).alias("cPop"), F.sum(second).alias("dPop"),
        F.sum(F.when(F.col(group) == focal, F.col(first))).alias("focal"),
    ).where(F.col("cPop") != 0)
    return rows.withColumns({
        "popChange": F.col("dPop") - F.col("cPop"),
        "pFocal": safe_div(F.col("focal"), F.col("cPop")),
        "increase": F.col("dPop") > F.col("cPop"),
    })
