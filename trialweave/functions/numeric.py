"""Scalar and array expressions; missing values are NULL, never NaN."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def missing(x: Column) -> Column:
    """NaN becomes NULL."""
    return F.nullif(x, F.lit(float("nan")))


def colon_count(x: float) -> int:
    """Whole steps of a range 1..x; values within four units of the last place of an integer count as that integer."""
    near = math.floor(x + 0.5)
    return max(0, near if abs(x - near) <= 4 * math.ulp(max(abs(x), 1.0)) else math.floor(x))


def colon_counts(x: Column) -> Column:
    """As colon_count(), of a column."""
    near = F.floor(x + 0.5)
    size = F.greatest(F.abs(x), F.lit(1.0))
    ulp = F.pow(F.lit(2.0), F.floor(F.log2(size)) - 52)
    return F.greatest(F.lit(0).cast("long"), F.when(F.abs(x - near) <= 4 * ulp, near).otherwise(F.floor(x)).cast("long"))


def half_away(x: Column) -> Column:
    """Rounded to an integer, halves away from zero."""
    return F.round(x)


def slice_inclusive(values: Column, first: int, last: int) -> Column:
    """Elements first..last, counted from 1, both included."""
    return F.slice(values, first, last - first + 1)


def window_frames(freq: float, ipi: float, n_pulses: float, pre: float, post: float) -> int:
    """Frames that a stimulus window spans after its first one; times in ms."""
    return math.ceil((ipi * n_pulses + pre + post) / 1000 * freq)


def response_length(freq: float, ipi: float, n_pulses: float, pre: float, post: float) -> int:
    return window_frames(freq, ipi, n_pulses, pre, post) + 2


def window_bounds(onset: Column, freq: float, ipi: float, n_pulses: float, pre: float, post: float) -> tuple[Column, Column]:
    """First and last frame (from 1, inclusive) of the window around an onset in seconds."""
    start = (onset - pre / 1000) * freq
    return F.floor(start).cast("long"), (F.ceil(start) + window_frames(freq, ipi, n_pulses, pre, post)).cast("long")


def pulse_positions(n_pulses: Column, ipi: float, pre: float, freq: float) -> Column:
    """Samples at which a sweep's pulses stand, as fractions; times in ms."""
    return F.when(n_pulses > 0, F.transform(F.sequence(F.lit(0).cast("long"), n_pulses.cast("long") - 1), lambda p: p * F.lit(ipi) / 1000 * freq + F.lit(pre) / 1000 * freq))


def trimmed_range(first_pulse: Column, freq: float, trim: float = 2.0) -> tuple[Column, Column]:
    """First and last sample (from 1, inclusive) before the first pulse, `trim` ms off at either end as far as one sample remains."""
    edge = math.floor(trim / 1000 * freq + 0.5)
    last = F.greatest(F.lit(1).cast("long"), half_away(first_pulse).cast("long") - 1)
    low = F.least(last, F.lit(1 + edge).cast("long"))
    return low, F.greatest(low, last - edge)


def pre_length(freq: float, pre: float) -> int:
    """Points before the stimulus that a baseline averages."""
    return colon_count(pre / 1000 * freq - 1)


def hazen(values: Column, percent: float) -> Column:
    """Percentile of an array by the midpoint rule: rank p/100*n + 1/2, linear between ranks, clamped; NULLs are left out."""
    ordered = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(ordered)
    h = F.greatest(F.lit(1.0), F.least(n.cast("double"), n * (percent / 100) + 0.5))
    low = F.floor(h).cast("int")
    at = lambda k: F.get(ordered, F.least(k, n) - 1)
    return F.when(n > 0, at(low) + (h - low) * (at(low + 1) - at(low)))


def single_safe_sd(x: Column) -> Column:
    """Sample standard deviation of the values present; of a single one it is 0, of none NULL."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def strict_sd(x: Column) -> Column:
    """Sample standard deviation, missing as soon as one value is."""
    return F.when(F.count(F.lit(1)) == F.count(x), single_safe_sd(x))


def polarised(x: Column, polarity: str) -> Column:
    """Responses of polarity '2' point down and are turned up."""
    return -x if polarity == "2" else x


# Student's t


def _beta_part(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        num = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-300)
        c = (1 + num / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_quantile(p: float, df: float) -> float | None:
    """Quantile of Student's t for p in (0.5, 1); None without degrees of freedom."""
    if df <= 0:
        return None
    low, high = 0.0, 1.0
    below = lambda t: 1 - 0.5 * _beta_part(df / 2, 0.5, df / (df + t * t)) < p
    while below(high):
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if below(mid) else (low, mid)
    return (low + high) / 2


#: Degrees of freedom up to which quantiles are tabulated; beyond, the expansion at infinity is exact to 1e-9.
T_TABLE = 200


def t_table(p: float) -> list[float]:
    return [t_quantile(p, df) for df in range(1, T_TABLE + 1)]


def t_column(p: float, df: Column) -> Column:
    """Quantile by table for small df, by the expansion in 1/df for large; NULL for df <= 0."""
    z = NormalDist().inv_cdf(p)
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    far = F.lit(z)
    for k, x in enumerate(g, 1):
        far = far + F.lit(x) / F.pow(df.cast("double"), F.lit(float(k)))
    return F.when(df <= 0, None).when(df <= T_TABLE, F.get(F.array(*map(F.lit, t_table(p))), (df - 1).cast("int"))).otherwise(far)


def strict_sd_over(x: Column, window) -> Column:
    """strict_sd over a window."""
    return F.when(F.count(F.lit(1)).over(window) == F.count(x).over(window), F.when(F.count(x).over(window) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x).over(window)))
