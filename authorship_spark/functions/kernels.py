"""Distance kernels over columns and arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def rounded(x: Column | str, places: int) -> Column:
    """``x`` rounded as SQL rounds a double: times 10^places, to the next whole number, halves away from zero.

    F.round takes the shortest decimal form: 333 / 640 reads 0.5203125 and goes up, but times 10^6 it's below the half.
    """
    x = F.col(x) if isinstance(x, str) else x
    scaled = F.abs(x) * 10.0**places
    whole = F.floor(scaled)
    near = F.signum(x) * (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / 10.0**places
    return F.when(scaled < 2.0**52, near).otherwise(x)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def cos_from(dot: Column, aa: Column, bb: Column, both_zero: float = 0.0) -> Column:
    """Cosine from sums of products; 0 if one vector is zero, ``both_zero`` if both are."""
    return F.when((aa == 0) & (bb == 0), F.lit(both_zero)).when((aa == 0) | (bb == 0), F.lit(0.0)).otherwise(dot / (F.sqrt(aa) * F.sqrt(bb)))


def cos_arr(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 1 if both are zero, 0 if one is."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x * y))
    return cos_from(dot, _sum(F.transform(a, lambda x: x * x)), _sum(F.transform(b, lambda x: x * x)), both_zero=1.0)


def kl_term(p: Column, q: Column) -> Column:
    """What p adds to the divergence from the mean of p and q, in nats."""
    return F.when(p > 0, p * F.log(p / ((p + q) / 2))).otherwise(0.0)


def jsd_from(a_terms: Column, b_terms: Column, a_empty: Column, b_empty: Column) -> Column:
    """Jensen-Shannon divergence in bits from the sums of both sides' terms."""
    value = F.least(F.lit(1.0), (a_terms * 0.5 + b_terms * 0.5) / math.log(2))
    return F.when(a_empty & b_empty, 0.0).when(a_empty | b_empty, 0.5).otherwise(value)


def jsd_hist(a: Column, b: Column) -> Column:
    return jsd_from(_sum(F.zip_with(a, b, kl_term)), _sum(F.zip_with(b, a, kl_term)), _sum(a) <= 0, _sum(b) <= 0)


def ks_statistic(a: Column, b: Column) -> Column:
    """Largest difference of the cumulative histograms."""
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("most"))

    def step(s: Column, p: Column) -> Column:
        x, y = s["x"] + p["x"], s["y"] + p["y"]
        return F.struct(x.alias("x"), y.alias("y"), F.greatest(s["most"], F.abs(x - y)).alias("most"))

    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.aggregate(pairs, start, step, lambda s: s["most"])


def rel_diff(a: Column, b: Column) -> Column:
    return F.when(a + b <= 0, 0.0).otherwise(F.abs(a - b) / (a + b))


def log_rel_diff(a: Column, b: Column) -> Column:
    """Relative difference of logarithms; very large where these cancel, to be clamped later."""
    x, y = F.log(F.greatest(a, F.lit(1e-9))), F.log(F.greatest(b, F.lit(1e-9)))
    return F.when((x + y == 0) & (a + b > 0), 0.0).otherwise(F.abs(x - y) / F.greatest(F.lit(1e-9), x + y))


def canberra_term(a: Column, b: Column, eps: float = 0.25) -> Column:
    return F.abs(a - b) / (a + b + 2 * eps)


def logistic(k: float, x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-k) * x))
