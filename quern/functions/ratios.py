"""Column functions for ratios that may be unmeasurable: NULL, never 0, where a denominator is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the two-sided 95 % quantile of the normal distribution.
Z95 = 1.959963984540054


def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def half_even(x: Column, digits: int) -> Column:
    """x as a double, rounded as SQL's round_even does: the product with the power of ten, in doubles, to the nearest whole number.

    `bround` rounds the shortest decimals instead, so 0.5015 to 3 digits gives 0.502 there and 0.501 here.
    """
    scaled = x.cast("double") * float(10**digits)
    return F.when(F.abs(scaled) < float("inf"), F.rint(scaled) / float(10**digits)).otherwise(x.cast("double"))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and f1; f1 is NULL where either is or both are 0."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r))}


def wilson(successes: Column, trials: Column, z: float = Z95) -> dict[str, Column]:
    """point, low and high of the score interval; NULL without trials."""
    n = F.when(trials > 0, trials.cast("double"))
    p = successes / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return {"point": p, "low": centre - half, "high": centre + half}
