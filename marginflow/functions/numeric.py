"""Numeric rules of the engine as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_cents(x: Column) -> Column:
    """Nearest integer, ties towards +infinity (``F.round`` goes away from zero)."""
    return F.floor(x + F.lit(0.5))


def round_quarter(x: Column) -> Column:
    """Hours to the nearest quarter."""
    return F.floor(x * 4 + F.lit(0.5)) / F.lit(4.0)


def round_to(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def at_least(x: Column, floor: float | int) -> Column:
    return F.greatest(x, F.lit(floor))


# Aggregates with the engine's rules for empty and single-row inputs.


def mean0(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def var0(x: Column) -> Column:
    return F.coalesce(F.var_samp(x), F.lit(0.0))


def sd0(x: Column) -> Column:
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def pearson0(x: Column, y: Column, more_than: int = 1) -> Column:
    """Correlation, 0 where either spread is 0 or there are too few pairs.

    Formed from the moments because ``F.corr`` fails on a constant series in ANSI mode.
    """
    pairs = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    r = F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))
    return F.when(pairs > more_than, F.coalesce(r, F.lit(0.0))).otherwise(F.lit(0.0))


def quantile0(x: Column, q: float) -> Column:
    """Interpolated on (n-1)q; 0 for an empty input."""
    return F.coalesce(F.percentile(x, q), F.lit(0.0))


# Coefficients of the rational approximation of the normal quantile.
_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.38357751867269e2, -3.066479806614716e1, 2.506628277459239)
_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1)
_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416)
_TAIL = 0.02425


def _horner(coefs, x):
    acc = coefs[0]
    for c in coefs[1:]:
        acc = acc * x + c
    return acc


def _tail(q):
    return _horner(_C, q) / _horner((*_D, 1.0), q)


def _centre(q):
    r = q * q
    return _horner(_A, r) * q / _horner((*_B, 1.0), r)


def normal_quantile_value(p: float) -> float:
    """Normal quantile of a constant, evaluated while the plan is built."""
    if not 0 < p < 1:
        raise ValueError("quantile level must lie strictly between 0 and 1")
    if p < _TAIL:
        return _tail(math.sqrt(-2 * math.log(p)))
    if p > 1 - _TAIL:
        return -_tail(math.sqrt(-2 * math.log(1 - p)))
    return _centre(p - 0.5)


def normal_quantile(p: Column) -> Column:
    """Normal quantile of a column; null outside (0, 1)."""
    low = _tail_col(F.sqrt(-2 * F.log(p)))
    high = -_tail_col(F.sqrt(-2 * F.log(1 - p)))
    inside = (p > 0) & (p < 1)
    return F.when(inside & (p < _TAIL), low).when(inside & (p > 1 - _TAIL), high).when(inside, _centre_col(p - 0.5))


def _horner_col(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def _tail_col(q: Column) -> Column:
    return _horner_col(_C, q) / _horner_col((*_D, 1.0), q)


def _centre_col(q: Column) -> Column:
    r = q * q
    return _horner_col(_A, r) * q / _horner_col((*_B, 1.0), r)


def student_t_quantile(p: float | Column, df: Column) -> Column:
    """Expansion of the t quantile in 1/df off the normal one; df is taken as at least 1."""
    z = F.lit(normal_quantile_value(p)) if isinstance(p, float) else normal_quantile(p)
    z3 = z * z * z
    z5 = z3 * z * z
    z7 = z5 * z * z
    first = (z3 + z) / 4
    second = (5 * z5 + 16 * z3 + 3 * z) / 96
    third = (3 * z7 + 19 * z5 + 17 * z3 - 15 * z) / 384
    d = at_least(df.cast("double"), 1.0)
    return z + first / d + second / (d * d) + third / (d * d * d)


def decay_at(cls: Column, half_life: Column, week: Column) -> Column:
    """Share of a claim still accruing in a week after eligibility, by persistence class."""
    half = F.lit(0.5)
    return (
        F.when(cls.isNull() | (cls == "structural"), F.lit(1.0))
        .when(cls == "upkeep", F.pow(half, week / F.greatest(F.coalesce(half_life, F.lit(1.0)), F.lit(1.0))))
        .otherwise(F.pow(half, week / F.greatest(F.coalesce(half_life, F.lit(52.0)), F.lit(52.0))))
    )
