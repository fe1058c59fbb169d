"""Negative-binomial column expressions; ``k`` is the shape, ``c`` the rate, the mean k / c."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_gamma(z: Column) -> Column:
    """ln Γ(z) for z > 0 by Stirling's series after a shift by eight; error below 1e-13."""
    shift = reduce(lambda a, b: a * b, [z + i for i in range(8)])
    w = z + 8
    series = 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7) + 1 / (1188 * w**9) - 691 / (360360 * w**11)
    return (w - 0.5) * F.log(w) - w + 0.9189385332046727 + series - F.log(shift)


def nb_logpmf(x: Column, k: Column, c: Column) -> Column:
    """Log probability of the count ``x``; shapes are kept within 1e-8 and 1e5. Nulls give null."""
    k = F.greatest(F.least(k, F.lit(1e5)), F.lit(1e-8))
    x = x.cast("double")
    return ln_gamma(x + k) - ln_gamma(k) - ln_gamma(x + 1) + k * F.log(c) - (x + k) * F.log1p(c)


def nb_pmf(x: Column, k: Column, c: Column) -> Column:
    return F.exp(nb_logpmf(x, k, c))


def zinb_logpmf(x: Column, k: Column, c: Column, zero: Column) -> Column:
    """With a share ``zero`` of zeros added."""
    base = nb_logpmf(x, k, c)
    return F.when(x == 0, F.log(zero + (1 - zero) * F.exp(base))).otherwise(F.log(1 - zero) + base)
