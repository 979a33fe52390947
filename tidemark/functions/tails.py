"""Tail probabilities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the complementary error function
# (absolute error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
# Unit-root test with a constant. Coefficients of the approximate p-value below and
# above the switching point, and of the critical values in powers of 1/n.
UNIT_ROOT_SWITCH = -1.61
UNIT_ROOT_SMALL = (2.1659, 1.4412, 0.038269)
UNIT_ROOT_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
UNIT_ROOT_1 = (-3.43035, -6.5393, -16.786, -79.433)
UNIT_ROOT_5 = (-2.86154, -2.8903, -4.234, -40.04)


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(c)
    return total


def normal_cdf(x: Column) -> Column:
    z = F.abs(x) / (2**0.5)
    t = 1 / (1 + 0.5 * z)
    tail = 0.5 * t * F.exp(-z * z + polynomial(ERFC, t))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def unit_root_p(statistic: Column) -> Column:
    small = normal_cdf(polynomial(UNIT_ROOT_SMALL, statistic))
    large = normal_cdf(polynomial(UNIT_ROOT_LARGE, statistic))
    return F.when(statistic <= UNIT_ROOT_SWITCH, small).otherwise(large)


def chi_square_tail(x: Column, df: int) -> Column:
    """P(X > x) for an even number of degrees of freedom: a finite sum."""
    if df % 2 or df < 2:
        raise ValueError("The number of degrees of freedom must be even.")
    half = x / 2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(state: Column, i: Column) -> Column:
        term = state["term"] * half / i
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    terms = F.sequence(F.lit(1), F.lit(df // 2 - 1)) if df > 2 else F.array().cast("array<int>")
    return F.exp(-half) * F.aggregate(terms, start, add, lambda s: s["total"])


def cumulative_gap_tail(b: Column, terms: int = 100) -> Column:
    """P-value of the largest gap of a cumulative periodogram."""
    series = F.transform(
        F.sequence(F.lit(1), F.lit(terms)), lambda j: F.pow(F.lit(-1.0), j - 1) * F.exp(-2 * b * b * j * j)
    )
    return F.least(F.greatest(2 * F.aggregate(series, F.lit(0.0), lambda acc, v: acc + v), F.lit(0.0)), F.lit(1.0))
