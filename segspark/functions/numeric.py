"""Column arithmetic with one rule for undefined values: they are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def xlnx(x: Column) -> Column:
    """``x ln x`` with the limit 0 at x = 0 (and for a missing count)."""
    x = x.cast("double")
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def ident(name: str) -> str:
    """A column name quoted for an expression string."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    """A string literal for an expression string."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def xlnx_text(x: str) -> str:
    """:func:`xlnx` as an expression string.

    Wide expressions are written as text: one parse instead of a call per operator.
    """
    return f"(CASE WHEN {x} > 0 THEN {x} * ln({x}) ELSE 0D END)"


def mass_text(counts: Sequence[str]) -> str:
    """``n * E`` of one unit, ``n ln n - sum(n_g ln n_g)``, from its group counts.

    Additive over units, so sums of it replace the joins that the shares would need.
    """
    known = [f"coalesce({c}, 0)" for c in counts]
    total = "(" + " + ".join(known) + ")"
    return f"({xlnx_text(total)} - ({' + '.join(xlnx_text(c) for c in counts)}))"


def safe_div(num: Column, den: Column) -> Column:
    """Quotient as double; NULL for a zero or missing denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def strict_sum(value: Column) -> Column:
    """Sum that is NULL as soon as one summand is NULL."""
    return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))


def finite_or(x: Column, default: Column) -> Column:
    """``x`` where it is a finite number, else ``default``."""
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(ok, x).otherwise(default)


def inverse_logit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero, for reports and comparisons."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)
