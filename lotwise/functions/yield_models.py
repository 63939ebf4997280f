"""Closed-form yield models and small statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def poisson(area: Column, density: Column) -> Column:
    return F.exp(-area * density)


def murphy(area: Column, density: Column) -> Column:
    ad = area * density
    return F.when(ad < 1e-10, F.lit(1.0)).otherwise(F.pow((1 - F.exp(-ad)) / ad, F.lit(2.0)))


def negative_binomial(area: Column, density: Column, alpha: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.pow(1 + area * density / alpha, -alpha)))


def moments_alpha(n: Column, mean: Column, variance: Column) -> Column:
    """Clustering parameter by moments; 1 below four dies or without defects, 50 when not over-dispersed."""
    clipped = F.least(F.lit(100.0), F.greatest(F.lit(0.05), mean * mean / (variance - mean)))
    return F.when((n < 4) | (mean == 0), F.lit(1.0)).when(variance <= mean, F.lit(50.0)).otherwise(F.round(clipped, 4))


def counted_alpha(n: Column, total: Column, squares: Column) -> Column:
    """:func:`moments_alpha` of ``n`` whole numbers by their sum and sum of squares.

    Whether they are over-dispersed is decided in whole numbers: where variance and mean are equal, the last
    bit of a variance in floating point depends on the order of the rows, and would turn 50 into 100.
    """
    whole = lambda c: c.cast("decimal(19,0)")
    excess = whole(n) * whole(squares) - whole(total) * whole(total + n - 1)
    ratio = total.cast("double") * total.cast("double") * (n - 1) / n / excess.cast("double")
    clipped = F.least(F.lit(100.0), F.greatest(F.lit(0.05), ratio))
    return F.when((n < 4) | (total == 0), F.lit(1.0)).when(excess <= 0, F.lit(50.0)).otherwise(F.round(clipped, 4))


def recommended_model(substrate: Column, alpha: Column, ad: Column) -> Column:
    wafer = F.when(alpha < 1, "negbinom").when(alpha < 10, "murphy").otherwise("poisson")
    return F.when(substrate == "wafer", wafer).otherwise(F.when(ad < 0.5, "poisson").otherwise("murphy"))


def critical_fraction(size: Column, density: Column, feature: Column) -> Column:
    return F.when(size <= 0, density).otherwise(F.least(F.lit(1.0), density * (1 + size / feature)))


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun's error-function polynomial (7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -erf).otherwise(erf))


def dies_per_wafer(diameter: Column, area: Column) -> Column:
    r = diameter / 2
    n = (F.lit(3.141592653589793) * r * r / area - F.lit(3.141592653589793) * diameter / F.sqrt(2 * area)).cast("int")
    return F.when((diameter <= 0) | (area <= 0), F.lit(0)).otherwise(F.greatest(F.lit(1), n))
