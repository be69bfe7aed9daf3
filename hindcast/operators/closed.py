"""Hourly candles around the reference session: movement shares, closed blocks, tracking, order books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import reference_open



def _by():
    return Window.partitionBy("instrument").orderBy("ts")


def candles(events: DataFrame) -> DataFrame:
    """(instrument, ts, c, hi, lo, qv): hourly bars of events (instrument, at, seq, value); values of 0 or less are left out."""
    good = events.filter("value > 0").withColumn("ts", F.date_trunc("hour", "at"))
    return good.groupBy("instrument", "ts").agg(F.max_by("value", F.struct("at", "seq")).alias("c"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.sum("value").alias("qv"))


def moves(hourly: DataFrame) -> DataFrame:
    """(instrument, ts, ret, open, traded): returns between neighbouring candles with positive closes."""
    old = F.lag("c").over(_by())
    out = hourly.withColumn("old", old).filter("old > 0 and c > 0")
    return out.select("instrument", "ts", (F.col("c") / F.col("old") - 1).alias("ret"), reference_open(F.col("ts")).alias("open"), (F.col("qv") > 0).alias("traded"))


def closed_hours(hourly: DataFrame) -> DataFrame:
    """Share of hours, movement and trading outside the reference session, by instrument."""
    m, closed = moves(hourly), ~F.col("open")
    size = F.abs("ret")
    return m.groupBy("instrument").agg(
        (F.count("*") + 1).alias("hours"), (100 * F.avg(closed.cast("int"))).alias("closed_hours_pct"), (100 * F.sum(F.when(closed, size).otherwise(0)) / F.nullif(F.sum(size), F.lit(0.0))).alias("closed_move_pct"),
        (100 * F.avg(F.when(closed, F.col("traded").cast("int")))).alias("traded_outside_pct"), (100 * F.avg(F.when(F.col("open"), F.col("traded").cast("int")))).alias("traded_inside_pct"),
        (F.stddev_samp(F.when(closed, F.col("ret"))) / F.nullif(F.stddev_samp(F.when(F.col("open"), F.col("ret"))), F.lit(0.0))).alias("sd_ratio"),
    )


def closed_blocks(hourly: DataFrame, least_hours: int = 12, weekend_hours: int = 48) -> DataFrame:
    """Runs of closed, contiguous hours: (instrument, start_ts, end_ts, hours, kind, entry, exit, return_pct, mae_pct, mfe_pct).

    A candle after a feed gap ends a run and is in none; a run needs a candle before it as entry.
    """
    contiguous = F.col("ts") == F.lag("ts").over(_by()) + F.expr("INTERVAL 1 HOUR")
    marked = hourly.withColumns({"inside": F.coalesce(contiguous, F.lit(False)) & ~reference_open(F.col("ts")), "before": F.lag("c").over(_by())})
    runs = marked.withColumn("run", F.sum((~F.col("inside")).cast("int")).over(_by())).filter("inside")
    by_time = lambda c: F.struct("ts", c)
    out = runs.groupBy("instrument", "run").agg(
        F.count("*").alias("hours"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.min(by_time("before"))["before"].alias("entry"), F.max(by_time("c"))["c"].alias("exit"),
        F.min(F.when(F.col("lo") > 0, F.col("lo"))).alias("low"), F.max(F.when(F.col("hi") > 0, F.col("hi"))).alias("high"),
    )
    out = out.filter((F.col("hours") >= least_hours) & (F.col("entry") > 0) & (F.col("exit") > 0))
    pct = lambda c: (F.col(c) / F.col("entry") - 1) * 100
    kind = F.when(F.col("hours") >= weekend_hours, "weekend").otherwise("overnight")
    return out.select("instrument", "start_ts", "end_ts", "hours", kind.alias("kind"), "entry", "exit", pct("exit").alias("return_pct"), pct("low").alias("mae_pct"), pct("high").alias("mfe_pct"))


def pooled(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """n, mean, median, sd, p10, p90, min, max and share negative."""
    c = F.col(x)
    q = F.percentile(c, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = rows.filter(c.isNotNull()).groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("min"), F.max(c).alias("max"), (100 * F.avg((c < 0).cast("int"))).alias("negative_pct"), q.alias("q"))
    return out.select("*", F.col("q")[0].alias("p10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p90")).drop("q")


def pool_blocks(blocks: DataFrame) -> DataFrame:
    """By kind: blocks, distinct starts, median return and excursion, share at or beyond -5 %."""
    return blocks.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("start_ts").alias("n_starts"), F.percentile("return_pct", 0.5).alias("median_return"), F.percentile("mae_pct", 0.5).alias("median_mae"), (100 * F.avg((F.col("mae_pct") <= -5).cast("int"))).alias("breach5_pct"))


def tracking(rows: DataFrame, key: str = "symbol", least: int = 3) -> DataFrame:
    """(key, n, correlation, error_bp, p10, p50, p90) of pairs of prices (key, d, x, y) on the dates that both have, over their changes from date to date.

    Correlation is null under ``least`` changes or where one side never moves; the tracking error is the
    deviation of x's change less y's, in basis points; the percentiles are of the premium x / y - 1.
    """
    met = rows.filter("x > 0 and y > 0")
    w = Window.partitionBy(key).orderBy("d")
    r = met.select(key, (F.col("x") / F.lag("x").over(w) - 1).alias("rx"), (F.col("y") / F.lag("y").over(w) - 1).alias("ry"), (F.col("x") / F.col("y") - 1).alias("premium"))
    n = F.count("rx")
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    q = F.percentile("premium", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = r.groupBy(key).agg(n.alias("n"), F.when((n >= least) & (spread > 0), F.covar_pop("rx", "ry") / F.nullif(spread, F.lit(0.0))).alias("correlation"), (F.stddev_samp(F.col("rx") - F.col("ry")) * 1e4).alias("error_bp"), q.alias("q"))
    return out.select(key, "n", "correlation", "error_bp", *(F.col("q")[i].alias(p) for i, p in enumerate(("p10", "p50", "p90"))))


def order_book(books: DataFrame, keys: list[str], by_price: bool, null_if_crossed: bool, near: tuple[float, float] = (50, 200)) -> DataFrame:
    """(keys, bid, ask, mid, spread_bp, top, depth_near, depth_far): books hold unordered levels (price, amount) in arrays bids and asks.

    Levels without a positive price are skipped; a book without either side has no figures. top: the
    smaller side's value at the best price; depths: the value within each of two distances from the middle (bp).
    The two venues differ: a level's value is amount x price or amount x mid, and a crossed book is null in one.
    """
    good = lambda side: F.filter(side, lambda x: (x["price"] > 0) & x["amount"].isNotNull())
    books = books.withColumns({"bids": good("bids"), "asks": good("asks")})
    top = books.withColumns({"bid": F.array_max(F.transform("bids", lambda x: x["price"])), "ask": F.array_min(F.transform("asks", lambda x: x["price"]))}).withColumn("mid", (F.col("bid") + F.col("ask")) / 2)
    total = lambda levels, value: F.aggregate(levels, F.lit(0.0), lambda s, x: s + value(x))

    def depth(side: str, bp: float) -> Column:
        return total(F.filter(side, lambda x: F.abs(x["price"] / F.col("mid") - 1) * 1e4 <= bp), lambda x: x["amount"] * (x["price"] if by_price else F.col("mid")))

    at = lambda side, price: total(F.filter(side, lambda x: x["price"] == F.col(price)), lambda x: x["amount"] * x["price"])
    figures = {"spread_bp": (F.col("ask") - F.col("bid")) / F.col("mid") * 1e4, "top": F.least(at("bids", "bid"), at("asks", "ask"))} | {name: depth("bids", bp) + depth("asks", bp) for name, bp in zip(("depth_near", "depth_far"), near)}
    fine = F.col("bid") < F.col("ask") if null_if_crossed else F.col("mid").isNotNull()
    return top.select(*keys, "bid", "ask", *(F.when(fine, c).alias(name) for name, c in ({"mid": F.col("mid")} | figures).items()))
