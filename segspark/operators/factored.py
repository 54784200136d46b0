"""Least squares by triangular factors that merge, for terms whose normal equations lose too many digits.

A power beside its base, or a term with a large mean, squares its condition in the normal equations of
``models.ols_models``. Here every task turns its rows into one triangular factor per model; factors are stacked and
factored again, in any order, as often as wanted.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.operators.models import OLS_SCHEMA, _finite, t_two_sided

FACTOR_SCHEMA = "model string, part int, n long, factor array<double>"
#: A term is aliased where what the terms before it leave of it is a smaller part of it than this.
ALIASED = 1e-11
#: Factors of the tasks are merged in this many groups, then those of the groups.
GROUPS = 64


def _triangle(rows: np.ndarray) -> np.ndarray:
    """Upper triangular, square, with the same inner products of columns as ``rows``."""
    r, k = np.linalg.qr(rows, mode="r"), rows.shape[1]
    return np.vstack([r, np.zeros((k - len(r), k))]) if len(r) < k else r


def model_factors(df: DataFrame, models: Mapping[str, tuple[Column, Mapping[str, Column]]]) -> DataFrame:
    """One row per model and task: usable rows and the factor of (1, terms, response), row by row.

    Rows stream through in Arrow batches; a task holds a batch and its factors. Each model leaves out its own rows
    with an unknown or infinite variable.
    """
    made, widths = {}, []
    for m, (response, terms) in enumerate(models.values()):
        ok = _finite({"y": response, **terms})
        for i, c in enumerate([*terms.values(), response]):
            made[f"v{m}_{i}"] = F.when(ok, c.cast("double"))
        widths.append(len(terms) + 1)
    labels = list(models)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [0] * len(labels)
        held = [np.zeros((w + 1, w + 1)) for w in widths]
        for batch in batches:
            for m, w in enumerate(widths):
                rows = batch[[f"v{m}_{i}" for i in range(w)]].to_numpy(dtype=float)
                rows = rows[~np.isnan(rows).any(axis=1)]
                if len(rows):
                    counts[m] += len(rows)
                    held[m] = _triangle(np.vstack([held[m], np.column_stack([np.ones(len(rows)), rows])]))
        part = TaskContext.get().partitionId()
        yield pd.DataFrame({"model": labels, "part": part, "n": counts, "factor": [f.ravel() for f in held]})

    return df.select(*[c.alias(k) for k, c in made.items()]).mapInPandas(reduce, FACTOR_SCHEMA)


def merge_factors(factors: DataFrame, groups: int) -> DataFrame:
    """Factors of each model merged to at most ``groups``; those of days or states that were stored merge alike."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(round(len(rows["factor"].iloc[0]) ** 0.5))
        stacked = np.vstack([np.asarray(f, dtype=float).reshape(k, k) for f in rows["factor"]])
        return pd.DataFrame({"model": rows["model"].iloc[:1], "part": rows["part"].iloc[:1] % groups, "n": [int(rows["n"].sum())],
                             "factor": [_triangle(stacked).ravel()]})

    return factors.groupBy("model", F.pmod("part", F.lit(groups))).applyInPandas(merge, FACTOR_SCHEMA)


def _fit(label: str, names: list[str], n: int, r: np.ndarray) -> list[tuple]:
    """Coefficients from the factor of one model."""
    k = len(names)
    free = [0] if n else []
    for j in range(1, k + 1 if n else 0):
        before = np.linalg.qr(r[:, free])[0]
        left = r[:, j] - before @ (before.T @ r[:, j])
        left -= before @ (before.T @ left)
        if np.linalg.norm(left) > ALIASED * np.linalg.norm(r[:, j]) and len(free) < n:
            free.append(j)
    q, t = np.linalg.qr(r[:, free]) if free else (np.zeros((k + 2, 0)), np.zeros((0, 0)))
    y = r[:, k + 1]
    along = q.T @ y
    coef = np.linalg.solve(t, along)
    rss = float(np.sum((y - q @ along) ** 2))
    tss = float(np.sum(along[1:] ** 2)) + rss
    dof = n - len(free)
    spread = np.linalg.norm(np.linalg.inv(t), axis=1) * np.sqrt(rss / dof) if dof > 0 else np.full(len(free), np.nan)
    bic = n * np.log(rss / n) + n + n * np.log(2 * np.pi) + (len(free) + 1) * np.log(n) if n and rss > 0 else np.nan
    estimates, errors = np.full(k + 1, np.nan), np.full(k + 1, np.nan)
    estimates[free], errors[free] = coef, spread
    out = []
    for term, e, s in zip(["(Intercept)", *names], estimates, errors):
        ratio = e / s if s > 0 else np.nan
        p = t_two_sided(ratio, dof) if np.isfinite(ratio) else np.nan
        out.append((label, term, e, s, ratio, p, n, 1 - rss / tss if tss > 0 else np.nan, rss, bic))
    return out


def ols_factored(df: DataFrame, models: Mapping[str, tuple[Column, Mapping[str, Column]]]) -> DataFrame:
    """As ``models.ols_models``, but by triangular factors: one pass over the rows, two merges of small matrices.

    A merge task holds one factor, (terms + 2)^2 numbers, of every ``GROUPS``-th task. A model without usable rows,
    and an aliased term, get rows with NULL estimates; with no row more than terms, errors are NULL.
    """
    terms = {label: list(t) for label, (_, t) in models.items()}

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows.iloc[0]
        names = terms[one["model"]]
        r = np.asarray(one["factor"], dtype=float).reshape(len(names) + 2, len(names) + 2)
        return pd.DataFrame(_fit(one["model"], names, int(one["n"]), r), columns=[c.split()[0] for c in OLS_SCHEMA.split(", ")])

    merged = merge_factors(merge_factors(model_factors(df, models), GROUPS), 1)
    return merged.groupBy("model").applyInPandas(fit, OLS_SCHEMA)
