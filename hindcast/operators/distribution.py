"""Empirical distributions, histograms, split-conformal scales and bands."""

from __future__ import annotations

from bisect import insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Thresholds of returns, levels of quantiles, drawdowns.
THRESHOLDS = (-0.20, -0.10, -0.05, 0.0, 0.05, 0.10)
LEVELS = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
DRAWDOWNS = (0.05, 0.10, 0.15, 0.20)


def share(condition: Column) -> Column:
    """Share of rows that meet a condition, of those where it is known."""
    return F.avg(condition.cast("int"))


def label(x: float) -> str:
    return f"{'m' if x < 0 else ''}{round(abs(x) * 100):02d}"


def moments(x: Column) -> dict[str, Column]:
    """n, mean, sample sd, population skew (n > 2) and excess kurtosis (n > 3)."""
    n, sd = F.count(x), F.stddev_samp(x)
    return {"n": n, "mean": F.avg(x), "sd": F.when(sd > 0, sd), "skew": F.when((n > 2) & (sd > 0), F.skewness(x)), "kurt": F.when((n > 3) & (sd > 0), F.kurtosis(x))}


def summarize(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Moments, range, quantiles (linear interpolation), spread and threshold probabilities of x by keys.

    P(x < t) for each threshold, but P(x > 0) for 0. One aggregation; null x is left out.
    """
    c = F.col(x)
    aggs = {**moments(c), "min": F.min(c), "max": F.max(c), "q": F.percentile(c, F.array(*map(F.lit, LEVELS)))}
    aggs |= {f"prob_{label(t)}": share(c > 0 if t == 0 else c < t) for t in THRESHOLDS}
    out = rows.filter(c.isNotNull()).groupBy(*keys).agg(*(v.alias(k) for k, v in aggs.items()))
    out = out.select("*", *(F.col("q")[i].alias(f"p{label(p)}") for i, p in enumerate(LEVELS))).drop("q")
    return out.withColumns({"iqr": F.col("p75") - F.col("p25"), "width80": F.col("p90") - F.col("p10"), "var90": -F.col("p10")})


def tail_mean(rows: DataFrame, keys: list[str], x: str, p: float = 0.10) -> DataFrame:
    """CVaR: minus the mean of the values at or under the p-quantile."""
    cut = rows.groupBy(*keys).agg(F.percentile(x, p).alias("cut"))
    return rows.join(cut, keys).filter(F.col(x) <= F.col("cut")).groupBy(*keys).agg((-F.avg(x)).alias("cvar90"), F.count("*").alias("n_tail"))


def breach_shares(rows: DataFrame, keys: list[str], mae: str, levels=DRAWDOWNS) -> DataFrame:
    """Share of excursions strictly beyond each drawdown."""
    return rows.filter(F.col(mae).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), *(share(F.col(mae) < -t).alias(f"breach_{label(t)}") for t in levels))


def tail_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Breaches at six drawdowns, the share that stays above -10 %, and reward over risk at the medians."""
    seen = breach_shares(rows, keys, "mae", (0.05, 0.10, 0.15, 0.20, 0.25, 0.30))
    risk = rows.groupBy(*keys).agg(share(F.col("mae") > -0.10).alias("holdable"), F.percentile("mae", 0.5).alias("mae_median"), F.percentile("mfe", 0.5).alias("mfe_median"))
    return seen.join(risk, keys).withColumn("reward_risk", F.when(F.col("mae_median") != 0, F.abs(F.col("mfe_median") / F.col("mae_median"))))


def histogram(rows: DataFrame, keys: list[str], x: str, bins: int) -> DataFrame:
    """(keys, bin, x0, x1, count, share): equal widths, the top edge in the last bin, empty bins included."""
    rows = rows.filter(F.col(x).isNotNull())
    ends = rows.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n"))
    ends = ends.withColumn("hi", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1e-6).otherwise(F.col("hi"))).withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    binned = rows.join(ends, keys).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col(x) - F.col("lo")) / F.col("step"))).cast("int"))
    counted = binned.groupBy(*keys, "bin").agg(F.count("*").alias("count"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(counted, [*keys, "bin"], "left").fillna({"count": 0})
    return out.select(*keys, "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("x0"), (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("x1"), "count", (F.col("count") / F.col("n")).alias("share"))


def conformal_scale(scores: DataFrame, keys: list[str], score: str, target: float = 0.8) -> DataFrame:
    """(keys, n, level, scale): the quantile of the scores at ceil((n + 1) target) / n, at most 1.

    Scores are counted first; the two around the level are found by rank in a sort that can spill.
    """
    kept = scores.filter(F.col(score).isNotNull())
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * F.lit(target)) / F.col("n"))
    sizes = kept.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("level", level).withColumn("at", (F.col("n") - 1) * F.col("level"))
    ranked = kept.select(*keys, F.col(score).alias("s")).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("s")) - 1)
    near = ranked.join(sizes, keys).filter(F.col("rank").between(F.floor("at"), F.ceil("at"))).groupBy(*keys, "n", "level", "at").agg(F.min("s").alias("a"), F.max("s").alias("b"))
    return near.select(*keys, "n", "level", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("scale"))


def band_scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage, width and bias of bands (lo, hi) for outcomes y; edges count as inside."""
    y, lo, hi = F.col("y"), F.col("lo"), F.col("hi")
    return rows.filter(y.isNotNull() & lo.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), share(y.between(lo, hi)).alias("coverage"), F.avg(hi - lo).alias("width"), F.avg(y - (lo + hi) / 2).alias("bias"), share(y > hi).alias("above"), share(y < lo).alias("below")
    )


def reliability(rows: DataFrame, levels=tuple(i / 10 for i in range(1, 10))) -> DataFrame:
    """(level, empirical, n): share of outcomes inside the band shrunk to each level."""
    half, centre = (F.col("hi") - F.col("lo")) / 2, (F.col("lo") + F.col("hi")) / 2
    usable = rows.filter(F.col("y").isNotNull() & (half > 0)).select(F.abs(F.col("y") - centre).alias("off"), half.alias("half"))
    each = usable.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return each.groupBy("level").agg(share(F.col("off") <= F.col("half") * F.col("level")).alias("empirical"), F.count("*").alias("n"))


def unconditional_band(grid: DataFrame, horizon: int, queries: DataFrame, target: float = 0.8, least: int = 30) -> DataFrame:
    """(entity, q, n, lo, hi, median) of all returns over ``horizon`` sessions that an entity had realised by q.

    queries: (entity, q). An entity's returns enter a sorted run in the order in which they are realised,
    and its queries read their three order statistics off it on the way: rows in proportion to returns and
    queries. A task holds the returns of one entity, at most one for each session of the calendar.
    """
    by = Window.partitionBy("entity").orderBy("session_idx")
    ahead = F.lead("a", horizon).over(by)
    returns = grid.select("entity", (F.col("session_idx") + horizon).cast("int").alias("q"), F.when((F.col("a") > 0) & (ahead > 0), ahead / F.col("a") - 1).alias("r")).filter("r is not null")
    places = ((1 - target) / 2, 1 - (1 - target) / 2, 0.5)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["q", "r"], na_position="last")  # what is realised by q comes before the query
        run, out = [], []
        for q, r in zip(rows["q"].tolist(), rows["r"].tolist()):
            if r == r:
                insort(run, r)
            elif len(run) >= least:
                at = [(len(run) - 1) * p for p in places]
                out.append((q, len(run), *(run[int(x)] + (run[min(int(x) + 1, len(run) - 1)] - run[int(x)]) * (x - int(x)) for x in at)))
        made = pd.DataFrame(out, columns=["q", "n", "lo", "hi", "median"])
        made.insert(0, "entity", rows["entity"].iloc[0])
        return made

    asked = queries.select("entity", F.col("q").cast("int").alias("q"), F.lit(None).cast("double").alias("r")).distinct()
    return returns.unionByName(asked).groupBy("entity").applyInPandas(grow, "entity string, q int, n long, lo double, hi double, median double")
