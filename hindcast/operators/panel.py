"""Calendar, bars and the joins that bring sparse observations onto sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(bars: DataFrame, benchmark: Column) -> DataFrame:
    """(session_idx, session_date): the distinct dates of the benchmark's bars, numbered from 0.

    One row a session: the calendar grows with time alone, so numbering it in one task is small.
    """
    dates = bars.filter(F.col("entity") == benchmark).select("session_date").distinct()
    return dates.select((F.row_number().over(Window.orderBy("session_date")) - 1).alias("session_idx"), "session_date")


def align(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every entity on every session, with nulls where it has no bar; bars off the calendar are dropped."""
    entities = bars.select("entity").distinct()
    # The calendar is a few thousand rows whatever the number of entities, so the grid is a map of entities.
    grid = entities.crossJoin(F.broadcast(calendar))
    return grid.join(bars, ["entity", "session_date"], "left")


def off_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars by entity on dates that the calendar lacks."""
    return bars.join(F.broadcast(calendar), "session_date", "left_anti").groupBy("entity").agg(F.count("*").alias("n_dropped"))


def asof(calendar: DataFrame, series: DataFrame) -> DataFrame:
    """(series_id, session_idx, value): the last observation on or before each session, null before the first.

    Observations and sessions are merged by date and the last value is carried: linear, no theta join.
    """
    ids = series.select("series_id").distinct()
    asked = ids.crossJoin(F.broadcast(calendar)).select("series_id", F.col("session_date").alias("d"), "session_idx", F.lit(None).cast("double").alias("value"))
    seen = series.select("series_id", F.col("obs_date").alias("d"), F.lit(None).cast("int").alias("session_idx"), F.col("value").cast("double"))
    # On one date the observation comes before the session.
    order = Window.partitionBy("series_id").orderBy("d", F.col("session_idx").asc_nulls_first())
    merged = asked.unionByName(seen).withColumn("value", F.last("value", ignorenulls=True).over(order))
    return merged.filter(F.col("session_idx").isNotNull()).select("series_id", "session_idx", "value")


def next_session(calendar: DataFrame, events: DataFrame) -> DataFrame:
    """``events`` with the first session on or after event_date (null if none): a forward as-of."""
    dates = events.select("event_date").distinct().select(F.col("event_date").alias("d"), F.lit(None).cast("int").alias("session_idx"))
    both = dates.unionByName(calendar.select(F.col("session_date").alias("d"), "session_idx"))
    order = Window.orderBy(F.col("d").desc(), F.col("session_idx").desc_nulls_last())
    found = both.withColumn("event_idx", F.last("session_idx", ignorenulls=True).over(order)).filter("session_idx is null")
    return events.join(found.select(F.col("d").alias("event_date"), "event_idx"), "event_date", "left")


def nearest_date(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each (entity, d) of left with the nearest date of right of its entity; ties go to the earlier.

    The nearest is the last one before or the first one after, so both are carried along instead of
    comparing all pairs.
    """
    both = left.select("entity", "d", F.lit(True).alias("asked")).distinct().unionByName(right.select("entity", "d", F.lit(False).alias("asked")).distinct())
    own = F.when(~F.col("asked"), F.col("d"))
    w = Window.partitionBy("entity").orderBy("d", "asked")
    back = Window.partitionBy("entity").orderBy(F.col("d").desc(), F.col("asked"))
    both = both.withColumns({"before": F.last(own, True).over(w), "after": F.last(own, True).over(back)}).filter("asked")
    gap = lambda c: F.abs(F.datediff(c, "d"))
    nearer = F.when(F.col("before").isNull() | (gap("after") < gap("before")), F.col("after")).otherwise(F.col("before"))
    return both.select("entity", "d", nearer.alias("nearest")).withColumn("days", gap("nearest"))


def coverage_report(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Rows, first and last session and number of events by entity."""
    n = events.groupBy("entity").agg(F.count("*").alias("n_events"))
    seen = bars.groupBy("entity").agg(F.count("*").alias("n_rows"), F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date"))
    return seen.join(n, "entity", "left").fillna(0, ["n_events"])


def date_clusters(dates: DataFrame, days: int) -> DataFrame:
    """(entity, d): greedy clustering, a date is kept if it is more than ``days`` after the last kept one.

    The rule depends on what was kept before, so it runs along one entity's sorted distinct dates, at most one for
    each day of the calendar. Null dates are left out.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], None
        for d in sorted(rows["d"]):
            if last is None or (d - last).days > days:
                kept.append(d)
                last = d
        return pd.DataFrame({"entity": rows["entity"].iloc[0], "d": kept})

    return dates.filter("d is not null").select("entity", "d").distinct().groupBy("entity").applyInPandas(keep, "entity string, d date")


def prefix_candidates(symbols: DataFrame, pairs: DataFrame, quote: str, most_extra: int = 3) -> DataFrame:
    """Pairs of a quote whose base starts with a symbol and has at most ``most_extra`` more characters.

    Each base is exploded into the few prefixes that could be a symbol, so the join is by equality.
    """
    known = pairs.filter(F.col("quote") == quote).select(F.upper("base").alias("b")).distinct()
    cut = F.transform(F.sequence(F.lit(0), F.lit(most_extra)), lambda k: F.left(F.col("b"), F.length("b") - k))
    bases = known.select(F.col("b").alias("base"), F.explode(cut).alias("symbol")).filter(F.length("symbol") > 0)
    found = bases.join(symbols.select(F.upper("symbol").alias("symbol")).distinct(), "symbol")
    rest = F.substr("base", F.length("symbol") + 1)
    return found.select("symbol", "base", F.concat("base", F.lit(f"_{quote}")).alias("pair"), F.when(rest == "", "(none)").otherwise(rest).alias("suffix"))
