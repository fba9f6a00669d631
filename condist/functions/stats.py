"""Column expressions of the statistical tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: limits and constants of the Kolmogorov series
SMALL, MIDDLE, LARGE = 0.2, 0.755, 6.8116
ROOT_TWO_PI = 2.50662827
C1 = -1.2337005501361697
C9 = 9 * C1
C25 = 25 * C1
#: A chunk is significant under this p-value.
SIGNIFICANCE = 0.01


def kolmogorov_p(z: Column) -> Column:
    """Asymptotic p-value of the scaled Kolmogorov-Smirnov statistic ``z``."""
    u = z * z
    low = 1 - ROOT_TWO_PI * (F.exp(C1 / u) + F.exp(C9 / u) + F.exp(C25 / u)) / z
    terms = F.greatest(F.rint(F.lit(3.0) / z), F.lit(1.0))
    high = F.lit(0.0)
    for j in range(1, 5):
        high = high + F.when(terms >= j, (1 if j % 2 else -1) * F.exp(-2.0 * j * j * u)).otherwise(0.0)
    return F.when(z < SMALL, 1.0).when(z < MIDDLE, low).when(z < LARGE, 2 * high).otherwise(0.0)


def linear(v: Column) -> Column:
    """Linear interpolation between neighbours lo_at, lo_value, hi_at, hi_value: 0 below the first knot, 1 above the last."""
    lo, lp, hi, hp = (F.col(c) for c in ("lo_at", "lo_value", "hi_at", "hi_value"))
    inside = lp + (v - lo) * (hp - lp) / (hi - lo)
    return F.when(lo.isNull(), F.when(hi == v, hp).otherwise(0.0)).when(hi.isNull(), 1.0).otherwise(inside)


def significant(p: Column) -> Column:
    return p < SIGNIFICANCE


def severity(count: Column, threshold: int = 3) -> Column:
    return F.when(count >= threshold, "critical").otherwise("warning")
