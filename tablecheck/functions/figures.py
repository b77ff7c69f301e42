"""Numeric expressions: percentages, corrected moments, KS p-value, PSI terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    """``100 * part / total`` rounded, 0 when there is nothing to divide by."""
    share = F.try_divide(part.cast("double") * F.lit(100.0), total.cast("double"))
    return F.when(total > 0, F.round(share, digits)).otherwise(F.lit(0.0))


def percent_of(part: float, total: float, digits: int = 2) -> float:
    """The same rule for figures already on the driver (half-up, as Spark rounds)."""
    if total <= 0:
        return 0.0
    return round_half_up(100.0 * part / total, digits)


def round_half_up(x: float, digits: int) -> float:
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def sample_skewness(population: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population moment; needs three values."""
    m = n.cast("double")
    return F.when(n >= 3, population * F.sqrt(m * (m - 1)) / (m - 2))


def sample_kurtosis(population: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population moment; needs four values."""
    m = n.cast("double")
    return F.when(n >= 4, (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * population + 6))


def ks_p_value(d: Column, n_ref: Column, n_new: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value.

    ``Q(x) = 2 * sum((-1)^(k-1) * exp(-2 k^2 x^2))`` with ``x = D * sqrt(n m / (n + m))``; the series
    is 1 to double precision below 0.2, where it converges too slowly to be summed.
    """
    x = d * F.sqrt(n_ref.cast("double") * n_new / (n_ref + n_new))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def psi_term(p_ref: Column, p_new: Column, floor: float = 1e-6) -> Column:
    """Population stability index of one category; shares are floored, not renormalised."""
    r, n = F.greatest(p_ref, F.lit(floor)), F.greatest(p_new, F.lit(floor))
    return (n - r) * F.ln(n / r)


def clip(c: Column, low: Column, high: Column) -> Column:
    """Keep within bounds; NULL stays NULL (``greatest`` and ``least`` would return a bound)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))
