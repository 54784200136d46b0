"""Linear and logistic regression on tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segspark.session import scratch_dir

OLS_SCHEMA = ("model string, term string, estimate double, std_error double, t double, p double, "
              "n long, r2 double, rss double, bic double")


def _finite(cols: Mapping[str, Column]) -> Column:
    """Rows a model can use: every variable known and finite."""
    cond = F.lit(True)
    for c in cols.values():
        d = c.cast("double")
        cond = cond & F.coalesce(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), F.lit(False))
    return cond


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) of Student's distribution."""
    from math import exp, lgamma, log

    if not np.isfinite(t) or df <= 0:
        return 0.0 if np.isinf(t) else float("nan")
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x in (0.0, 1.0):
        return x
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1.0 - x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


def _solve(names: Sequence[str], label: str, row: pd.Series, tag: str) -> list[tuple]:
    """Coefficients from means and covariances of one model (p x p numbers)."""
    k, n, my, yy = len(names), int(row["n" + tag]), row["my" + tag], row["yy" + tag]
    S = np.empty((k, k))
    for i in range(k):
        for j in range(k):
            a, b = min(i, j), max(i, j)
            S[i, j] = row[f"c{a}_{b}{tag}"]
    sy = np.array([row[f"y{i}{tag}"] for i in range(k)])
    means = np.array([row[f"m{i}{tag}"] for i in range(k)])
    # A term that the terms before it explain is aliased: it has no estimate and the others keep theirs.
    free = []
    for i in range(k if n > 1 else 0):
        rest = S[i, i] - (S[i, free] @ np.linalg.solve(S[np.ix_(free, free)], S[free, i]) if free else 0.0)
        if rest > 1e-12 * S[i, i] > 0 and len(free) < n - 1:
            free.append(i)
    inv = np.linalg.inv(S[np.ix_(free, free)])
    coef, centre = inv @ sy[free], means[free]
    rss = max((n - 1) * (yy - coef @ sy[free]), 0.0) if n > 1 else 0.0
    tss = (n - 1) * yy if n > 1 else 0.0
    dof = n - len(free) - 1
    s2 = rss / dof if dof > 0 else np.nan
    var = s2 * inv / max(n - 1, 1)
    beta, errors = np.full(k, np.nan), np.full(k, np.nan)
    beta[free], errors[free] = coef, np.sqrt(np.diag(var))
    est = [my - coef @ centre if n else np.nan, *beta]
    se = [np.sqrt(s2 / n + centre @ var @ centre) if n else np.nan, *errors]
    bic = n * np.log(rss / n) + n + n * np.log(2 * np.pi) + (len(free) + 2) * np.log(n) if rss > 0 else np.nan
    out = []
    for term, e, s in zip(["(Intercept)", *names], est, se):
        t = e / s if s > 0 else np.nan
        out.append((label, term, e, s, t, t_two_sided(t, dof), n, 1 - rss / tss if tss > 0 else np.nan, rss, bic))
    return out


def ols_models(df: DataFrame, models: Mapping[str, tuple[Column, Mapping[str, Column]]]) -> DataFrame:
    """Least squares with intercept for several models ``{label: (response, terms)}``.

    Gives estimate, standard error, t, p, and n, R2, RSS, BIC. One pass over the rows serves
    all models: built-in mean and covariance aggregates, which are stable and merge in any
    order, give the normal equations in centred form. Every model leaves out its own unusable
    rows. Only those few numbers reach the solver, as a single row. A model with
    too few rows, and an aliased term, get rows with NULL estimates.
    """
    made, stats = {}, {}
    for m, (response, terms) in enumerate(models.values()):
        ok = _finite({"y": response, **terms})
        made[f"y{m}"] = F.when(ok, response.cast("double"))
        stats |= {f"n_{m}": f"count(y{m})", f"my_{m}": f"avg(y{m})", f"yy_{m}": f"var_samp(y{m})"}
        for i, c in enumerate(terms.values()):
            x = f"x{m}_{i}"
            made[x] = F.when(ok, c.cast("double"))
            stats |= {f"m{i}_{m}": f"avg({x})", f"y{i}_{m}": f"covar_samp({x}, y{m})"}
            stats |= {f"c{j}_{i}_{m}": f"covar_samp(x{m}_{j}, {x})" for j in range(i + 1)}
    plans = [(label, list(terms)) for label, (_, terms) in models.items()]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in OLS_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for _, one in batch.iterrows():
                for m, (label, names) in enumerate(plans):
                    rows += _solve(names, label, one, f"_{m}")
            yield pd.DataFrame(rows, columns=columns)

    sums = df.select(*[c.alias(k) for k, c in made.items()]).agg(*[F.expr(e).alias(k) for k, e in stats.items()])
    return sums.mapInPandas(fit, OLS_SCHEMA)


def contrasts(factor: str, levels: Sequence[str]) -> dict[str, Column]:
    """Indicator terms of a categorical predictor; the first level is the base, a level that is not listed an error."""
    known = F.col(factor).isin(list(levels))
    other = F.raise_error(F.concat(F.lit(f"level of {factor} not listed: "), F.col(factor).cast("string")))
    return {
        f"{factor}{v}": F.when(known, (F.col(factor) == v).cast("double")).when(~known, other.cast("double"))
        for v in levels[1:]
    }


def ols(df: DataFrame, response: Column, terms: Mapping[str, Column], label: str = "model") -> DataFrame:
    """One model of :func:`ols_models`."""
    return ols_models(df, {label: (response, terms)})


def ols_simple(df: DataFrame, response: Column, predictor: Column, by: Sequence[str] = ()) -> DataFrame:
    """One predictor, per group: slope, intercept and R2 from built-in aggregates."""
    ready = df.where(_finite({"y": response, "x": predictor})).select(
        *by, response.cast("double").alias("y"), predictor.cast("double").alias("x"))
    return ready.groupBy(*by).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"), F.count(F.lit(1)).alias("n"),
    )


def ols_factor(df: DataFrame, response: Column, factor: str) -> DataFrame:
    """One categorical predictor: mean of the first level, then each level minus it.

    The window holds one row per level, as many as the model has coefficients.
    """
    ready = df.where(_finite({"y": response}) & F.col(factor).isNotNull())
    means = ready.groupBy(factor).agg(F.avg(response.cast("double")).alias("_m"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(factor)
    rows = means.withColumns({"_rn": F.row_number().over(w), "_m0": F.first("_m").over(w)})
    is_base = F.col("_rn") == 1
    return rows.select(
        F.when(is_base, F.lit("(Intercept)")).otherwise(F.concat(F.lit(factor), F.col(factor))).alias("term"),
        F.when(is_base, F.col("_m")).otherwise(F.col("_m") - F.col("_m0")).alias("estimate"), "n",
    )


def bic_simple(df: DataFrame, response: Column, predictors: Mapping[str, Column]) -> DataFrame:
    """BIC of one-predictor models, all from one scan; each model drops its own unusable rows."""
    items = [
        F.struct(F.lit(m).alias("model"),
                 F.when(_finite({"y": response, "x": c}), response.cast("double")).alias("y"),
                 c.cast("double").alias("x"))
        for m, c in predictors.items()
    ]
    long = df.select(F.explode(F.array(*items)).alias("_e")).select("_e.*").where(F.col("y").isNotNull())
    s = long.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.regr_syy("y", "x").alias("_syy"),
        F.regr_sxy("y", "x").alias("_sxy"), F.regr_sxx("y", "x").alias("_sxx"))
    rss = F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx"))
    n = F.col("n").cast("double")
    bic = n * F.ln(rss / n) + n + n * F.lit(float(np.log(2 * np.pi))) + F.lit(3.0) * F.ln(n)
    return s.select("model", "n", rss.alias("rss"), bic.alias("bic"))


def logit(df: DataFrame, response: Column, terms: Mapping[str, Column], max_iter: int = 50) -> DataFrame:
    """Binomial regression with logit link: estimate, standard error, z and p of every term.

    The rows are first counted by distinct (response, terms) and that table is written to the
    shared scratch folder: every step of the reweighted least squares then reads the short
    weighted table instead of repeating what built ``df``, also after a lost executor.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    spark, names = df.sparkSession, list(terms)
    ready = df.where(_finite({"y": response, **terms})).select(
        response.cast("double").alias("label"), *[c.cast("double").alias(n) for n, c in terms.items()])
    path = scratch_dir(spark, "logit")
    ready.groupBy("label", *names).agg(F.count(F.lit(1)).cast("double").alias("weight")).write.parquet(path)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(spark.read.parquet(path))
    fit = GeneralizedLinearRegression(family="binomial", link="logit", weightCol="weight", maxIter=max_iter, tol=1e-10)
    model = fit.fit(data.select("label", "features", "weight"))
    # The summary lists the intercept last.
    coef = [*[float(b) for b in model.coefficients], float(model.intercept)]
    se, z, p = (list(map(float, v)) for v in (
        model.summary.coefficientStandardErrors, model.summary.tValues, model.summary.pValues))
    rows = list(zip([*names, "(Intercept)"], coef, se, z, p))
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, z double, p double")
