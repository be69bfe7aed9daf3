"""The feature panel: 28 point-in-time features of each entity on each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FEATURES, MIN_HISTORY


def _by():
    return Window.partitionBy("entity").orderBy("session_idx")


def past(rows: int) -> "Window":
    """The current session and the ``rows`` before it."""
    return _by().rowsBetween(-rows, 0)


def change(x: str, k: int) -> Column:
    """x over its value k sessions ago, less 1; null where either is missing or the older one is 0."""
    old = F.lag(x, k).over(_by())
    return F.when(old != 0, F.col(x) / old - 1)


def log_return(x: str = "a") -> Column:
    old = F.lag(x, 1).over(_by())
    return F.when(old > 0, F.ln(F.col(x) / old))


def from_high(price: Column, high: str, rows: int) -> Column:
    top = F.max(high).over(past(rows))
    return F.when(top > 0, price / top - 1)


def name_features(grid: DataFrame) -> DataFrame:
    """Features of an entity's own bars, on the dense calendar; returns use the adjusted close,
    distances from highs and gaps the traded prices."""
    lr = grid.withColumns({"lr": log_return(), "gap": F.when(F.lag("c", 1).over(_by()) > 0, F.abs(F.col("o") / F.lag("c", 1).over(_by()) - 1)), "dv": F.col("v") * F.col("c")})
    i = F.col("session_idx")
    year = F.sqrt(F.lit(252.0))
    out = lr.withColumns(
        {
            "ret5": change("a", 5),
            "ret20": change("a", 20),
            "ret60": change("a", 60),
            "dist52": from_high(F.col("c"), "h", 251),
            "vol20": F.when(i >= 20, F.stddev_samp("lr").over(past(19)) * year),
            "vol5": F.when(i >= 5, F.stddev_samp("lr").over(past(4)) * year),
            "dd60": from_high(F.col("a"), "a", 59),
            "gap20": F.avg("gap").over(past(19)),
            "dv20": F.when(i >= 19, F.avg("dv").over(past(19))),
        }
    )
    older = _by().rowsBetween(-249, -20)
    settled = F.when(i >= 20, F.col("dv20"))
    out = out.withColumns({"dv_mean": F.avg(settled).over(older), "dv_sd": F.stddev_samp(settled).over(older)})
    return out.withColumns(
        {
            "vol20": F.col("vol20").cast("float"),
            "ret20": F.col("ret20").cast("float"),
            "dv20z": F.when(F.col("dv_sd") > 0, (F.col("dv20") - F.col("dv_mean")) / F.col("dv_sd")),
        }
    ).withColumn("vol_ratio", F.when(F.col("vol20") > 0, F.col("vol5") / F.col("vol20").cast("double")))


def market_features(grid: DataFrame, benchmark: Column, growth: Column) -> DataFrame:
    """(session_idx, mkt_ret20, mkt_vol20, mkt_dist52, growth_rel20), one row a session.

    As in the definition, a growth or benchmark return of exactly 0 counts as missing for the difference.
    """
    base = grid.withColumn("lr", log_return())
    one = base.filter(F.col("entity") == benchmark).select(
        "session_idx", change("a", 20).alias("mkt_ret20"), F.when(F.col("session_idx") >= 20, F.stddev_samp("lr").over(past(19)) * F.sqrt(F.lit(252.0))).alias("mkt_vol20"), from_high(F.col("c"), "h", 251).alias("mkt_dist52")
    )
    two = base.filter(F.col("entity") == growth).select("session_idx", change("a", 20).alias("growth_ret20"))
    gone = lambda c: F.nullif(F.col(c), F.lit(0.0))
    return one.join(two, "session_idx", "left").select("session_idx", "mkt_ret20", "mkt_vol20", "mkt_dist52", (gone("growth_ret20") - gone("mkt_ret20")).alias("growth_rel20"))


def macro_features(levels: DataFrame) -> DataFrame:
    """From carried levels (session_idx, vix, slope, fed, bei, usd, oil, hy, btc, fng), one row a session."""
    w = Window.orderBy("session_idx")  # one row a session
    old = lambda c, k: F.lag(c, k).over(w)
    ratio = lambda c, k: F.when(old(c, k) > 0, F.col(c) / old(c, k) - 1)
    less = lambda c, k: F.col(c) - old(c, k)
    return levels.select(
        "session_idx", "vix", F.when(F.col("vix") > 0, ratio("vix", 5)).alias("vix_chg5"), "slope", less("fed", 63).alias("d_rate90"), less("bei", 20).alias("bei_chg20"), ratio("usd", 20).alias("usd_chg20"),
        ratio("oil", 20).alias("oil_chg20"), (less("hy", 20) * 100).alias("hy_chg20"), ratio("btc", 5).alias("btc_ret5"), ratio("btc", 20).alias("btc_ret20"), (F.col("fng") / 100).alias("fng"),
    )


def event_features(grid: DataFrame, entity_events: DataFrame, market_events: DataFrame) -> DataFrame:
    """(entity, session_idx, dte, event_load5, is_fomc_day).

    entity_events: (entity, event_idx); market_events: (session_idx). dte is in calendar days up to
    the next event's session, at most 45 and 45 without one.
    """
    own = entity_events.filter("event_idx is not null").select("entity", F.col("event_idx").alias("session_idx")).distinct().withColumn("own", F.lit(True))
    all_of = market_events.select("session_idx").distinct().withColumn("fomc", F.lit(1))
    both = grid.select("entity", "session_idx", "session_date").join(own, ["entity", "session_idx"], "left").join(F.broadcast(all_of), "session_idx", "left").fillna({"fomc": 0})
    ahead = F.min(F.when(F.col("own"), F.col("session_date"))).over(_by().rowsBetween(0, Window.unboundedFollowing))
    dte = F.coalesce(F.least(F.lit(45), F.datediff(ahead, "session_date")), F.lit(45))
    load = F.coalesce(F.sum("fomc").over(_by().rowsBetween(1, 5)), F.lit(0))
    both = both.withColumns({"dte": dte, "load": load})
    return both.select("entity", "session_idx", "dte", (F.col("load") + (F.col("dte") <= 7).cast("int")).alias("event_load5"), F.col("fomc").alias("is_fomc_day"))


def feature_panel(grid: DataFrame, levels: DataFrame, entity_events: DataFrame, market_events: DataFrame, benchmark: Column, growth: Column) -> DataFrame:
    """(entity, session_idx, session_date, o, h, l, c, a, v, 28 features as float, valid).

    Features are null where the adjusted close is; a row is valid from session MIN_HISTORY on if its
    close, ret20 and vol20 are there. Date-level features are one row a session and are broadcast.
    """
    shared = market_features(grid, benchmark, growth).join(macro_features(levels), "session_idx")
    panel = name_features(grid).join(F.broadcast(shared), "session_idx", "left").join(event_features(grid, entity_events, market_events), ["entity", "session_idx"], "left")
    panel = panel.withColumn("rel_bench20", F.col("ret20").cast("double") - F.col("mkt_ret20"))
    there = F.col("a").isNotNull()
    panel = panel.select("entity", "session_idx", "session_date", "o", "h", "l", "c", "a", "v", *(F.when(there, F.col(f).cast("float")).alias(f) for f in FEATURES))
    valid = (F.col("session_idx") >= MIN_HISTORY) & there & F.col("ret20").isNotNull() & F.col("vol20").isNotNull()
    return panel.withColumn("valid", valid)
