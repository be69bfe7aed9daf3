"""Hourly candles and closed-session alerts over a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import reference_open


def hourly_candles(ticks: DataFrame, late: str = "2 hours") -> DataFrame:
    """(instrument, ts, c, hi, lo, qv, open) of ticks (instrument, at, seq, value), streaming or not.

    Ticks of 0 or less, and those later than the watermark, are left out; state is one row for each
    instrument and open hour.
    """
    good = ticks.filter("value > 0").withWatermark("at", late)
    hour = F.window("at", "1 hour")
    out = good.groupBy("instrument", hour.alias("w")).agg(F.max_by("value", F.struct("at", "seq")).alias("c"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.sum("value").alias("qv"))
    return out.select("instrument", F.col("w.start").alias("ts"), "c", "hi", "lo", "qv", reference_open(F.col("w.start")).alias("open"))
