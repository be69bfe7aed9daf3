"""Out-of-sample validation: query grids, predictors, scores and their uncertainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normal_cdf
from .distribution import conformal_scale


def query_grid(panel: DataFrame, calendar: DataFrame, date_from: str, date_to: str | None, stride: int, horizon: int, least: int = 60) -> DataFrame:
    """(entity, session_idx): systematic sample of an era's sessions, every ``stride``-th by place in the
    era, on all valid entities; a query needs ``least`` sessions before it and ``horizon`` after it."""
    era = calendar.filter(F.col("session_date") >= F.lit(date_from).cast("date"))
    if date_to:
        era = era.filter(F.col("session_date") <= F.lit(date_to).cast("date"))
    last = calendar.agg(F.max("session_idx").alias("last"))
    placed = era.withColumn("n", F.row_number().over(Window.orderBy("session_idx")) - 1).crossJoin(F.broadcast(last))
    kept = placed.filter((F.col("n") % stride == 0) & (F.col("session_idx") >= least) & (F.col("session_idx") + horizon <= F.col("last"))).select("session_idx")
    return panel.filter("valid").join(F.broadcast(kept), "session_idx").select("entity", "session_idx")


def trailing_vol(grid: DataFrame, rows: int = 60, least: int = 20) -> DataFrame:
    """(entity, session_idx, sd): sample sd of the last log returns, null under ``least`` of them."""
    by = Window.partitionBy("entity").orderBy("session_idx")
    old = F.lag("a", 1).over(by)
    lr = grid.withColumn("lr", F.when((old > 0) & (F.col("a") > 0), F.ln(F.col("a") / old)))
    w = by.rowsBetween(-(rows - 1), 0)
    return lr.select("entity", "session_idx", F.when(F.count("lr").over(w) >= least, F.stddev_samp("lr").over(w)).alias("sd"))


def clustered(rows: DataFrame, keys: list[str], cluster: str, x: str) -> DataFrame:
    """Mean of x over rows, and its standard error over unweighted cluster means (null for one cluster)."""
    per = rows.filter(F.col(x).isNotNull()).groupBy(*keys, cluster).agg(F.avg(x).alias("own_mean"), F.sum(x).alias("own_sum"), F.count("*").alias("own_rows"))
    return per.groupBy(*keys).agg(F.sum("own_rows").alias("n"), (F.sum("own_sum") / F.sum("own_rows")).alias("mean"), (F.stddev_samp("own_mean") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("clusters"))


def pit_deciles(rows: DataFrame) -> DataFrame:
    """(decile, n, chi_part): counts of the probability integral transform, and each term of chi-square."""
    held = rows.filter("pit is not null").select(F.least(F.lit(9), F.floor(F.col("pit") * 10)).cast("int").alias("decile"))
    counted = held.groupBy("decile").agg(F.count("*").alias("n"))
    all_of = held.sparkSession.range(10).select(F.col("id").cast("int").alias("decile")).join(counted, "decile", "left").fillna({"n": 0})
    expected = F.sum("n").over(Window.partitionBy()) / 10  # ten rows
    return all_of.withColumn("expected", expected).select("decile", "n", ((F.col("n") - F.col("expected")) ** 2 / F.col("expected")).alias("chi_part"))


def by_slice(rows: DataFrame, slices: list[str], predictor: str, hit: str, width: str) -> DataFrame:
    """Coverage and width by predictor and one slice at a time, in one pass of grouping sets."""
    sets = [[predictor, s] for s in slices]
    level = F.grouping_id()
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], F.col(predictor), *map(F.col, slices)).agg(level.alias("g"), F.count("*").alias("n"), F.avg(F.col(hit).cast("int")).alias("coverage"), F.avg(width).alias("width"))
    name = F.coalesce(*(F.when(F.col(s).isNotNull(), F.lit(s)) for s in slices))
    return out.select(predictor, name.alias("slice"), F.coalesce(*(F.col(s).cast("string") for s in slices)).alias("value"), "n", "coverage", "width").filter("slice is not null")


def by_symbol(rows: DataFrame, least: int = 10) -> DataFrame:
    """Coverage and mean width of bands (lo, hi) by entity, of those with at least ``least`` outcomes."""
    held = rows.filter("y is not null and lo is not null")
    out = held.groupBy("entity").agg(F.count("*").alias("n"), F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("int")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"))
    return out.filter(F.col("n") >= least)


def directional(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share of outcomes y whose sign is that of the predicted median; zero is a sign of its own."""
    held = rows.filter("y is not null and median is not null")
    return held.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.signum("y") == F.signum("median")).cast("int")).alias("hit_rate"))


def dispersion(rows: DataFrame, keys: list[str], coverage: str, width: str, vol: str, target: float) -> DataFrame:
    """Spread of coverage over entities, how many are within 10 points, and corr(width, vol); null if undefined."""
    c = F.col(coverage)
    spread = F.stddev_pop(width) * F.stddev_pop(vol)
    related = F.when(spread > 1e-9, F.covar_pop(width, vol) / F.nullif(spread, F.lit(0.0)))  # widths of a constant predictor differ by rounding alone
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_samp(c).alias("sd"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum((F.abs(c - target) <= 0.10).cast("int")).alias("within"), related.alias("corr"), q.alias("q"))
    return out.withColumn("iqr", F.col("q")[1] - F.col("q")[0]).drop("q")


def brier(rows: DataFrame, keys: list[str], p: str, y: str) -> DataFrame:
    """Mean squared error of a probability, and mean p where the event came and where it didn't."""
    square = (F.col(p) - F.col(y)) ** 2
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(square).alias("brier"), F.avg(F.when(F.col(y) == 1, F.col(p))).alias("p_event"), F.avg(F.when(F.col(y) == 0, F.col(p))).alias("p_none"))


def auc(rows: DataFrame, keys: list[str], p: str, y: str) -> DataFrame:
    """Mann-Whitney AUC with average ranks for ties, null unless both outcomes occur.

    Equal scores are summed first, so the running count sees one row a distinct score.
    """
    ties = rows.groupBy(*keys, p).agg(F.count("*").alias("tied_rows"), F.sum(F.col(y).cast("long")).alias("pos"))
    w = Window.partitionBy(*keys).orderBy(p)
    ranked = ties.withColumn("rank", F.sum("tied_rows").over(w) - (F.col("tied_rows") - 1) / 2)
    total = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("n_pos"), (F.sum("tied_rows") - F.sum("pos")).alias("n_neg"))
    a, b = F.col("n_pos"), F.col("n_neg")
    return total.select(*keys, "n_pos", "n_neg", F.when((a > 0) & (b > 0), (F.col("r") - a * (a + 1) / 2) / (a * b)).alias("auc"))


# Edges of the bins of predicted probabilities.
PATH_BINS = (0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0001)


def path_reliability(rows: DataFrame, keys: list[str], p: str, y: str) -> DataFrame:
    """(keys, bin, n, mean_p, rate) over seven uneven bins of the predicted probability."""
    number = F.coalesce(*(F.when(F.col(p) < top, F.lit(i)) for i, top in enumerate(PATH_BINS[1:])))
    return rows.withColumn("bin", number).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def reflection_probability(level: float, sd: Column, horizon: int) -> Column:
    """P(the path breaches -level) of a driftless walk: twice the end point's tail, at most 1."""
    return F.least(F.lit(1.0), 2 * normal_cdf(-level / (sd * F.sqrt(F.lit(float(horizon))))))


def fallback_rate(rows: DataFrame, y: str, least: int = 10) -> DataFrame:
    """(entity, rate): an entity's own rate, the pooled one under ``least`` rows."""
    own = rows.groupBy("entity").agg(F.count("*").alias("n"), F.avg(y).alias("own"), F.sum(y).alias("s"))
    whole = own.agg((F.sum("s") / F.sum("n")).alias("all"))
    return own.crossJoin(F.broadcast(whole)).select("entity", "n", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("all")).alias("rate"))


def matched_multiplier(rows: DataFrame, keys: list[str], off: str, half: str, target: float = 0.8, least: float = 0.05, most: float = 20.0) -> DataFrame:
    """(keys, n, multiplier, coverage, width): the smallest factor on the half-widths that covers ``target`` of the outcomes.

    That is an order statistic of off / half, the ceil(target n)-th, held within [least, most]; it is found
    by rank in a sort that can spill.
    """
    kept = rows.filter(F.col(off).isNotNull() & (F.col(half) > 0)).withColumn("ratio", F.col(off) / F.col(half))
    sizes = kept.groupBy(*keys).agg(F.count("*").alias("n"))
    ranked = kept.select(*keys, "ratio").withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("ratio")))
    at = ranked.join(sizes, keys).filter(F.col("rank") == F.ceil(F.lit(target) * F.col("n")))
    factor = at.select(*keys, F.greatest(F.lit(least), F.least(F.lit(most), F.col("ratio"))).alias("multiplier"))
    met = kept.join(F.broadcast(factor), keys)  # one row of each key
    return met.groupBy(*keys).agg(F.count("*").alias("n"), F.first("multiplier").alias("multiplier"), F.avg((F.col("ratio") <= F.col("multiplier")).cast("int")).alias("coverage"), F.avg(2 * F.col(half) * F.col("multiplier")).alias("width"))


def floor_cuts(rows: DataFrame, x: str, shares: tuple[float, ...]) -> DataFrame:
    """One row with an array of the values at place floor(p (n - 1)) of the sorted x, for each share p; empty without any x."""
    kept = rows.filter(F.col(x).isNotNull()).select(F.col(x).alias("x"))
    counts = kept.groupBy("x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("x"))  # a row for each distinct value
    ends = counts.select("x", upto.alias("upto"))
    size = kept.agg(F.count("*").alias("size")).filter("size > 0")
    met = ends.join(F.broadcast(size))
    return met.groupBy().agg(F.count("*").alias("values"), F.array(*(F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("size") - 1)), F.col("x"))) for p in shares)).alias("cuts")).filter("values > 0").select("cuts")


def regime(x: Column, cuts: Column) -> Column:
    """low, mid or high by two cuts, each of which belongs below; null without x."""
    return F.when(x <= cuts[0], "low").when(x <= cuts[1], "mid").when(x.isNotNull(), "high")


def frozen_bands(rows: DataFrame, target: float = 0.8, unscaled: tuple[str, ...] = ("analog_raw", "own_past")) -> DataFrame:
    """Test rows of (era, entity, q, predictor, centre, half, y) with their scale, off, lo and hi, multipliers frozen on the calibration rows.

    A predictor's multiplier is the conformal scale of |y - centre| / half over era 'calibration';
    ``unscaled`` predictors keep 1. Rows without a positive half-width or an outcome count nowhere; ``off``
    is the outcome's distance from the centre in half-widths, inside the band up to ``scale``.
    """
    usable = rows.filter("half > 0 and centre is not null and y is not null").withColumn("off", F.abs(F.col("y") - F.col("centre")) / F.col("half"))
    scales = conformal_scale(usable.filter("era = 'calibration'"), ["predictor"], "off", target).select("predictor", "scale")
    scaled = usable.filter("era = 'test'").join(F.broadcast(scales), "predictor", "left")  # a row for each predictor
    scaled = scaled.withColumn("scale", F.when(F.col("predictor").isin(*unscaled), 1.0).otherwise(F.col("scale"))).filter("scale is not null")
    reach = F.col("half") * F.col("scale")
    return scaled.withColumns({"lo": F.col("centre") - reach, "hi": F.col("centre") + reach})


def frozen_scores(rows: DataFrame, target: float = 0.8, unscaled: tuple[str, ...] = ("analog_raw", "own_past")) -> DataFrame:
    """(predictor, scale, n, coverage, width) of ``frozen_bands``."""
    scaled = frozen_bands(rows, target, unscaled)
    hit = (F.col("off") <= F.col("scale")).cast("int")
    return scaled.groupBy("predictor").agg(F.first("scale").alias("scale"), F.count("*").alias("n"), F.avg(hit).alias("coverage"), F.avg(2 * F.col("half") * F.col("scale")).alias("width"))
