"""Probabilities that a path breaches a drawdown: predictors frozen on a calibration era, and their scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import validation

# Drawdown levels, predictors in order of report, fewest calibration rows of an own rate, resamples and their seed.
LEVELS = (0.05, 0.10, 0.20)
PREDICTORS = ("analog_mae", "vol_reflection", "same_name", "pooled")
LEAST_OWN = 10
RESAMPLES, SEED = 400, 20260924


def level_name(level: float) -> str:
    return f"p{round(level * 100):02d}"


def analog_risk(states: DataFrame, keys: Sequence[str], levels: Sequence[float] = LEVELS) -> DataFrame:
    """(keys, n_mae, median_mae, p05, ...): share of a query's states whose excursion is at or beyond each level."""
    shares = (F.avg((F.col("mae") <= -level).cast("int")).alias(level_name(level)) for level in levels)
    return states.groupBy(*keys).agg(F.count("mae").alias("n_mae"), F.percentile("mae", 0.5).alias("median_mae"), *shares)


def breach_rows(probed: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """(level, era, entity, q, y, analog_mae, vol, reason): each scored query at each level, and why it can't be used.

    probed: (era, entity, q, mae, sigma_h, p05, ...), mae being the query's own excursion and sigma_h the
    volatility over the horizon. y: 1 if its own path breached. vol is the reflection principle's probability
    of a driftless walk. reason: no_path, no_excursion, no_volatility in this order, null for usable rows.
    """
    each = F.array(*(F.struct(F.lit(level).alias("level"), F.col(level_name(level)).alias("analog_mae")) for level in levels))
    rows = probed.select("era", "entity", "q", "mae", "sigma_h", F.inline(each))
    z = -F.col("level") / F.col("sigma_h")
    vol = F.when(F.col("sigma_h") > 0, F.least(F.lit(1.0), 2 * validation.normal_cdf(z)))
    reason = F.when(F.col("mae").isNull(), "no_path").when(F.col("analog_mae").isNull(), "no_excursion").when(vol.isNull(), "no_volatility")
    return rows.select("level", "era", "entity", "q", (F.col("mae") <= -F.col("level")).cast("int").alias("y"), "analog_mae", vol.alias("vol_reflection"), reason.alias("reason"))


def dropped(rows: DataFrame) -> DataFrame:
    """(level, reason, n): test rows by the reason for which they are dropped, 'used' for those that aren't."""
    return rows.filter("era = 'test'").groupBy("level", F.coalesce("reason", F.lit("used")).alias("reason")).agg(F.count("*").alias("n"))


def predictions(rows: DataFrame) -> DataFrame:
    """(level, entity, q, y, analog_mae, vol_reflection, same_name, pooled, fallback) of the usable test rows.

    Rates are those of the calibration era's rows with a path, by entity and of all; an entity with under
    LEAST_OWN of them has the pooled rate, which ``fallback`` says. Without calibration rows nothing is predicted.
    """
    known = rows.filter("era = 'calibration' and y is not null")
    own = known.groupBy("level", "entity").agg(F.count("*").alias("n_own"), F.avg("y").alias("own"))
    pooled = known.groupBy("level").agg(F.avg("y").alias("pooled"))
    usable = rows.filter("era = 'test' and reason is null").drop("era", "reason")
    met = usable.join(F.broadcast(pooled), "level").join(own, ["level", "entity"], "left")  # one row a level
    fallback = F.coalesce(F.col("n_own") < LEAST_OWN, F.lit(True))
    return met.select("level", "entity", "q", "y", "analog_mae", "vol_reflection", F.when(fallback, F.col("pooled")).otherwise(F.col("own")).alias("same_name"), "pooled", fallback.alias("fallback"))


def by_predictor(rows: DataFrame) -> DataFrame:
    """(level, predictor, entity, q, y, p)."""
    return rows.unpivot(["level", "entity", "q", "y"], list(PREDICTORS), "predictor", "p")


def scores(rows: DataFrame) -> DataFrame:
    """(level, predictor, n, brier, se, clusters, auc, p_mean, p_event, p_none): errors are clustered by query session."""
    long = by_predictor(rows).withColumn("square", (F.col("p") - F.col("y")) ** 2)
    keys = ["level", "predictor"]
    error = validation.clustered(long, keys, "q", "square").select(*keys, "n", F.col("mean").alias("brier"), "se", "clusters")
    split = validation.brier(long, keys, "p", "y").drop("n", "brier")
    mean = long.groupBy(*keys).agg(F.avg("p").alias("p_mean"))
    return error.join(split, keys).join(mean, keys).join(validation.auc(long, keys, "p", "y").select(*keys, "auc"), keys)


def breach_calibration(rows: DataFrame) -> DataFrame:
    """(level, n, predicted, realised, gap, se): the analogs' mean probability against what happened, by level."""
    gap = rows.withColumn("gap", F.col("analog_mae") - F.col("y"))
    error = validation.clustered(gap, ["level"], "q", "gap").select("level", "n", F.col("mean").alias("gap"), "se")
    return rows.groupBy("level").agg(F.avg("analog_mae").alias("predicted"), F.avg("y").alias("realised")).join(error, "level").select("level", "n", "predicted", "realised", "gap", "se")


def draw(seed: Column, resample: Column, turn: Column, size: Column) -> Column:
    """The place in 0 .. size - 1 that a resample takes at a turn: a hash of the counters, so any task can make any draw."""
    key = F.concat_ws(":", seed.cast("string"), resample.cast("string"), turn.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") % size


def resampled(clusters: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(keys, resample, sums): sums over as many clusters as there are, drawn with replacement, for each resample.

    clusters: (keys, order, sums), a row for each cluster (a query session). A resample's draws are rows of
    their own, which are joined to the clusters by place and added up with partial sums: no task holds a
    resample, nor the clusters of a key.
    """
    from pyspark.sql import Window

    by = Window.partitionBy(*keys).orderBy(order)  # a row for each session
    placed = clusters.withColumn("place", F.row_number().over(by) - 1)
    size = clusters.groupBy(*keys).agg(F.count("*").alias("size"))
    turns = size.select(*keys, "size", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    turns = turns.repartition(*keys, "resample").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    drawn = turns.select(*keys, "resample", draw(F.lit(seed), F.col("resample"), F.col("turn"), F.col("size")).alias("place"))
    return drawn.join(placed, [*keys, "place"]).groupBy(*keys, "resample").agg(*(F.sum(c).alias(c) for c in sums))


def paired_bootstrap(rows: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(level, predictor, delta, low, high, share_better): analogs' Brier score less that of each other predictor.

    Whole sessions are drawn, as rows of one session share its market; the interval holds 95 % of the
    resamples' differences, and share_better those under 0.
    """
    square = {k: (F.col(k) - F.col("y")) ** 2 for k in PREDICTORS}
    per = rows.groupBy("level", "q").agg(F.count("*").alias("n"), *(F.sum(x).alias(k) for k, x in square.items()))
    differences = [F.struct(F.lit(k).alias("predictor"), ((F.col("analog_mae") - F.col(k)) / F.col("n")).alias("d")) for k in PREDICTORS[1:]]
    sums = ["n", *PREDICTORS]
    each = resampled(per, ["level"], "q", sums, resamples, seed).select("level", F.inline(F.array(*differences)))
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    spread = each.groupBy("level", "predictor").agg(q.alias("q"), F.avg((F.col("d") < 0).cast("int")).alias("share_better"))
    whole = per.groupBy("level").agg(*(F.sum(c).alias(c) for c in sums)).select("level", F.inline(F.array(*differences)))
    return whole.join(spread, ["level", "predictor"]).select("level", "predictor", F.col("d").alias("delta"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "share_better")
