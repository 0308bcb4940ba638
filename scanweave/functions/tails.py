"""Tail probabilities (chi-square, Student t) as column expressions, right for any degrees of freedom.

Both are a ratio of two integrals of the same density by Simpson's rule, taken relative to the density's peak and in
logarithms. So no normalising constant is needed, and nothing over- or underflows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from scanweave.functions.exprs import col

STEPS = 2000  # even


def _integral(f: Callable[[Column], Column], a: Column, b: Column) -> Column:
    h = (b - a) / STEPS
    weight = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, i: s + weight(i) * f(a + h * i))
    return total * h / 3


def _finite(p: Column, given: Column) -> Column:
    bad = p.isNull() | F.isnan(p) | (p < 0) | (p > 1 + 1e-9)
    return F.when(given, F.when(bad, F.raise_error(F.lit("tail probability out of range")).cast("double")).otherwise(F.least(p, F.lit(1.0))))


def chi2_upper(q: str | Column, df: str | Column) -> Column:
    """P(X >= q); null for df below 1. With x = u^2 the density has its peak at m = sqrt(df - 1) and width below 1."""
    q, df = col(q).cast("double"), col(df).cast("double")
    m = F.sqrt(F.greatest(df - 1, F.lit(0.0)))
    u0, lo = F.sqrt(F.greatest(q, F.lit(0.0))), F.greatest(m - 10, F.lit(0.0))

    def density(u: Column) -> Column:
        return (F.when(df == 1, F.exp(-u * u / 2)).when(u <= 0, F.lit(0.0))
                .otherwise(F.exp((df - 1) * F.log1p((u - m) / m) - (u - m) * (u + m) / 2)))

    p = _integral(density, F.greatest(u0, lo), F.greatest(u0, m) + 10) / _integral(density, lo, m + 10)
    return _finite(p, q.isNotNull() & (df >= 1))


def t_two_sided(t: str | Column, df: str | Column) -> Column:
    """P(|T| >= |t|); null for df below 1. With t = sqrt(df) tan(a) the density is cos(a)^(df - 1)."""
    t, df = col(t).cast("double"), col(df).cast("double")
    a0 = F.atan(F.abs(t) / F.sqrt(df))
    top = F.when(df < 100, F.lit(1.5707963267948966)).otherwise(F.atan(40 / F.sqrt(df)))  # nothing is left beyond t = 40

    def density(a: Column) -> Column:
        rest = -F.sin(a) * F.sin(a)
        return F.when(df == 1, F.lit(1.0)).when(rest <= -1, F.lit(0.0)).otherwise(F.exp((df - 1) / 2 * F.log1p(rest)))

    p = _integral(density, a0, F.greatest(a0, top)) / _integral(density, F.lit(0.0), top)
    return _finite(p, t.isNotNull() & (df >= 1))
