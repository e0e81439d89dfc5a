"""Tail probabilities that Spark has no built-in for.

Plain formulas (continued fractions over ``math.lgamma``), applied as Arrow
functions to result frames that hold one row per test.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

_TINY = 1e-300
NORMAL_FROM = 3000.0  # degrees of freedom


def _continued_fraction(term, first: float) -> float:
    """Modified Lentz evaluation of b0 + a1/(b1 + a2/(b2 + ...))."""
    value = first or _TINY
    c, d = value, 0.0
    for i in range(1, 100_000):
        a, b = term(i)
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return value
    raise ArithmeticError("a continued fraction did not converge")


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(1.0 - x, b, a)

    def term(i: int) -> tuple[float, float]:
        m = i // 2
        if i == 1:
            return 1.0, 1.0
        k = i - 1
        m = k // 2
        if k % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    log_front = (
        a * math.log(x) + b * math.log1p(-x)
        + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    )
    return math.exp(log_front) / a * _continued_fraction(term, 0.0)


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(s, x)."""
    if x <= 0.0:
        return 1.0
    log_front = s * math.log(x) - x - math.lgamma(s)
    if x < s + 1:
        term = total = 1.0 / s
        k = s
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1.0 - math.exp(log_front) * total
    fraction = _continued_fraction(
        lambda i: (1.0, x + 1 - s) if i == 1
        else (-(i - 1) * (i - 1 - s), x + 2 * i - 1 - s), 0.0
    )
    return math.exp(log_front) * fraction


def t_two_sided(t: float, df: float) -> float:
    """The beta function, or above ``NORMAL_FROM`` degrees the normal tail at a
    deviate transformed by an expansion in 1/df, whose error there is below
    double precision."""
    if df < NORMAL_FROM:
        return beta_tail(df / (df + t * t), df / 2, 0.5)
    a = df - 0.5
    square = a * math.log1p(t * t / df)
    x = math.sqrt(square)
    b = 48.0 * a * a
    below = 10.0 * b * (b + 0.8 * square * square + 100.0)
    x += x * (square + 3.0) / b - x * (((4.0 * square + 33.0) * square + 240.0) * square + 855.0) / below
    return normal_two_sided(x)


def chi_square_upper(chi2: float, dof: float) -> float:
    return gamma_upper(dof / 2, chi2 / 2)


def normal_two_sided(z: float) -> float:
    return min(1.0, math.erfc(z / math.sqrt(2)))


def rank_sum_counts(m: int, n: int) -> list[int]:
    """In how many of the orders of ``m`` and ``n`` different values U is 0, 1, ... m n."""
    counts = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        # Times (1 - q^(n+i)) / (1 - q^i), the next factor of the Gaussian binomial.
        for u in range(m * n, n + i - 1, -1):
            counts[u] -= counts[u - n - i]
        for u in range(i, m * n + 1):
            counts[u] += counts[u - i]
    return counts


def rank_sum_two_sided(u: float, n1: float, n0: float) -> float:
    """Probability of a U as far from the middle as this one, without ties."""
    m, n = int(n1), int(n0)
    counts = rank_sum_counts(min(m, n), max(m, n))
    above = sum(counts[math.ceil(max(u, m * n - u)):])
    return min(1.0, 2 * above / sum(counts))


def rank_sum_p_value():
    """The exact p where it applies (small and without ties), else the normal one."""
    @F.pandas_udf("double")
    def p(u: pd.Series, n1: pd.Series, n0: pd.Series, z: pd.Series, exact: pd.Series) -> pd.Series:
        small, large = _over(rank_sum_two_sided, u.where(exact), n1, n0), _over(normal_two_sided, z)
        return small.where(exact, large)
    return p


def _over(fn, *columns: pd.Series) -> pd.Series:
    return pd.Series([
        None if any(pd.isna(v) for v in row) else fn(*row)
        for row in zip(*columns, strict=True)
    ], dtype="float64")


def t_p_value():
    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return _over(t_two_sided, t, df)
    return p


def chi_square_p_value():
    @F.pandas_udf("double")
    def p(chi2: pd.Series, dof: pd.Series) -> pd.Series:
        return _over(chi_square_upper, chi2, dof)
    return p


def normal_p_value():
    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return _over(normal_two_sided, z)
    return p
