"""Scalar rules as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_HORIZON, DEFAULT_K, HORIZONS, LEAST_K, MOST_K


def round_half_up(x: Column, digits: int) -> Column:
    """Rounding with halves toward +infinity; null stays null."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by a polynomial approximation of erf (error under 1.5e-7)."""
    # Coefficients of the approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * F.abs(x) / F.sqrt(F.lit(2.0)))
    poly = reduce(lambda acc, c: acc * t + c, reversed(a), F.lit(0.0)) * t
    erf = 1 - poly * F.exp(-x * x / 2)
    return 0.5 * (1 + F.when(x >= 0, erf).otherwise(-erf))


def snap_horizon(x: Column, ties_longer: bool) -> Column:
    """The measured horizon nearest to x; a tie goes to the longer or the shorter one; DEFAULT_HORIZON if unusable."""
    sign = -1 if ties_longer else 1
    best = F.array_min(F.array(*(F.struct(F.abs(x - h).alias("d"), F.lit(sign * h).alias("h")) for h in HORIZONS)))["h"] * sign
    return F.when(x > 0, best).otherwise(DEFAULT_HORIZON)


def clamp_k(x: Column) -> Column:
    """A neighbour count, rounded and held between the limits; the default if unusable."""
    return F.when(x > 0, F.greatest(F.lit(LEAST_K), F.least(F.lit(MOST_K), F.floor(x + 0.5)))).otherwise(DEFAULT_K).cast("int")


def sentiment_band(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score <= 25, "Extreme Fear").when(score <= 45, "Fear").when(score <= 55, "Neutral").when(score <= 75, "Greed").otherwise("Extreme Greed")


def tracking_tier(correlation: Column, error_bp: Column) -> Column:
    return F.when((correlation >= 0.95) & (error_bp <= 60), "tight").when(correlation >= 0.85, "fair").when(correlation >= 0.5, "loose").otherwise("rejected")


def price_ratio_ok(last: Column, reference: Column, percent: float = 7.0) -> Column:
    return F.abs(last / reference - 1) * 100 <= percent


def display_value(x: Column, unit: Column) -> Column:
    return F.when(unit == "pct", F.round(x * 100, 2)).when(unit == "bp", F.round(x, 2)).otherwise(F.round(x, 3))


def horizon_label(h: Column) -> Column:
    return F.when(h == 1, "1 session").when(h == 5, "1 week (5 sessions)").when(h == 20, "1 month (20 sessions)").when(h == 60, "1 quarter (60 sessions)").otherwise(F.concat(h.cast("string"), F.lit(" sessions")))


def reference_open(ts: Column) -> Column:
    """Whether a UTC time lies in the reference session: Monday to Friday, hours 13 to 20."""
    return (F.weekday(ts) < 5) & F.hour(ts).between(13, 20)


def upper_median(values: Column) -> Column:
    """Element n // 2 of the sorted array: not interpolated."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def floor_index_quantile(values: Column, p: float) -> Column:
    """Element floor(p (n - 1)) of the sorted array."""
    return F.get(F.sort_array(values), F.floor((F.size(values) - 1) * p).cast("int"))
