"""Expanding statistics over all entities, and clipped z-scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FEATURES, Z_CLIP


def unpivot(panel: DataFrame) -> DataFrame:
    """(entity, session_idx, feature, x) of the valid rows' features that are there."""
    long = panel.filter("valid").unpivot(["entity", "session_idx"], FEATURES, "feature", "x")
    return long.filter(F.col("x").isNotNull())


def session_stats(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """(session_idx, n, mu, sd), arrays in the order of FEATURES: every valid row dated on or before each session.

    Rows are summed by session before the shuffle, all features at once; the running sums then see one
    row a session of the calendar, in one task. With at most two values mu is 0 and sd 1; a variance
    of 0 gives sd 1.
    """
    x = {f: F.col(f).cast("double") for f in FEATURES}
    each = {"n": lambda c: F.count(c), "s": lambda c: F.sum(c), "q": lambda c: F.sum(c * c)}
    daily = panel.filter("valid").groupBy("session_idx").agg(*(agg(x[f]).alias(f"{k}_{f}") for f in FEATURES for k, agg in each.items()))
    w = Window.orderBy("session_idx")
    run = calendar.select("session_idx").join(daily, "session_idx", "left").select("session_idx", *(F.coalesce(F.sum(f"{k}_{f}").over(w), F.lit(0)).alias(f"{k}_{f}") for f in FEATURES for k in each))

    def mean(f: str) -> Column:
        return F.when(F.col(f"n_{f}") > 2, F.col(f"s_{f}") / F.col(f"n_{f}")).otherwise(0.0)

    def deviation(f: str) -> Column:
        n, s = F.col(f"n_{f}"), F.col(f"s_{f}")
        variance = (F.col(f"q_{f}") - s * s / n) / (n - 1)
        return F.when((n > 2) & (variance > 0), F.sqrt(F.abs(variance))).otherwise(1.0)

    return run.select("session_idx", F.array(*(F.col(f"n_{f}").cast("long") for f in FEATURES)).alias("n"), F.array(*map(mean, FEATURES)).alias("mu"), F.array(*map(deviation, FEATURES)).alias("sd"))


def expanding_stats(stats: DataFrame) -> DataFrame:
    """(feature, session_idx, n, mu, sd): ``session_stats`` with a row for each feature."""
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.col("n")[i].alias("n"), F.col("mu")[i].alias("mu"), F.col("sd")[i].alias("sd")) for i, f in enumerate(FEATURES)))
    return stats.select("session_idx", F.inline(each)).select("feature", "session_idx", "n", "mu", "sd")


def clip(z: Column, most: float = Z_CLIP) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), z))


def z_rows(panel: DataFrame, stats: DataFrame) -> DataFrame:
    """(entity, session_idx, z): each valid row's features by its own session's statistics, clipped, in the order of FEATURES.

    A session's statistics are one row of ``session_stats``; the panel meets it by session, and every
    feature stays in its row.
    """
    joined = panel.filter("valid").select("entity", "session_idx", *FEATURES).join(stats.select("session_idx", "mu", "sd"), "session_idx")
    z = F.array(*(F.when(F.col(f).isNotNull(), clip((F.col(f).cast("double") - F.col("mu")[i]) / F.col("sd")[i])).cast("float") for i, f in enumerate(FEATURES)))
    return joined.select("entity", "session_idx", z.alias("z"))


def z_scores(rows: DataFrame) -> DataFrame:
    """(entity, session_idx, feature, z): the values of ``z_rows`` that are there, a row for each."""
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.col("z")[i].alias("z")) for i, f in enumerate(FEATURES)))
    return rows.select("entity", "session_idx", F.inline(each)).filter("z is not null")


def z_vectors(rows: DataFrame, names: list[str]) -> DataFrame:
    """(entity, session_idx, z): the named features of ``z_rows``, null where missing."""
    return rows.select("entity", "session_idx", F.array(*(F.col("z")[FEATURES.index(f)] for f in names)).alias("z"))
