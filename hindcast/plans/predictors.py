"""The validation sweep: five predictors over two eras of queries, with multipliers frozen on the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import distribution, pathrisk, retrieval, validation
from .queries import HORIZON, K, query
from .scenarios import pools
from .tables import Panel

#: Eras of queries and the stride of their systematic samples, which is the design of the sweep.
ERAS = {"calibration": ("1996-01-01", "1997-06-30"), "test": ("1997-07-01", None)}
STRIDE = 20
#: Fewest outcomes that the pooled band is taken from.
LEAST_POOLED = 100
#: Fewest returns of chosen states; a query with fewer is dropped.
LEAST_RETURNS = 10

_ERA = " UNION ALL ".join(
    f"SELECT '{era}' AS era, session_idx FROM (SELECT session_idx, row_number() OVER (ORDER BY session_idx) - 1 AS n FROM calendar WHERE session_date >= DATE '{first}'{f" AND session_date <= DATE '{last}'" if last else ''}) WHERE n % {STRIDE} = 0 AND session_idx >= 60 AND session_idx + 5 <= (SELECT max(session_idx) FROM calendar)"
    for era, (first, last) in ERAS.items()
)
_ROWS = f"""WITH RECURSIVE times AS ({_ERA}), sweep AS MATERIALIZED (SELECT era, f.entity, f.session_idx AS q, row_number() OVER (ORDER BY f.entity, f.session_idx) AS query_id, 60 AS j_low, f.session_idx - 5 AS j_high FROM times JOIN features f USING (session_idx) WHERE valid),
sz AS MATERIALIZED (SELECT query_id, feature, CAST(x.z AS DOUBLE) AS qz FROM sweep s JOIN z x ON x.entity = s.entity AND x.session_idx = s.q), {pools("sz", "sweep")},
near AS (SELECT query_id, quantile_cont(y, 0.5) AS m, stddev_samp(y) AS sd, quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM states JOIN outcomes5 USING (entity, session_idx) GROUP BY query_id HAVING count(y) >= {LEAST_RETURNS}),
past AS (SELECT query_id, quantile_cont(o.y, 0.5) AS m, quantile_cont(o.y, 0.1) AS lo, quantile_cont(o.y, 0.9) AS hi FROM sweep s JOIN outcomes5 o ON o.entity = s.entity AND o.session_idx + 5 <= q WHERE o.y IS NOT NULL GROUP BY query_id HAVING count(*) >= 30),
vol AS (SELECT entity, session_idx, CASE WHEN count(lr) OVER w >= 20 THEN stddev_samp(lr) OVER w END AS sd FROM returns WINDOW w AS (PARTITION BY entity ORDER BY session_idx ROWS 59 PRECEDING)),
pooled AS (SELECT quantile_cont(y, 0.5) AS m, quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM outcomes5 WHERE session_idx + 5 <= (SELECT max(session_idx) FROM calendar WHERE session_date <= DATE '{ERAS["calibration"][1]}') AND y IS NOT NULL HAVING count(*) >= {LEAST_POOLED}),
bands AS (SELECT query_id, 'analog_conformal' AS predictor, m AS centre, sd AS half FROM near UNION ALL SELECT query_id, 'analog_raw', (lo + hi) / 2, (hi - lo) / 2 FROM near UNION ALL SELECT query_id, 'own_past', m, (hi - lo) / 2 FROM past
UNION ALL SELECT query_id, 'volatility', 0, sd * sqrt(5) FROM sweep s JOIN vol v ON v.entity = s.entity AND v.session_idx = s.q UNION ALL SELECT query_id, 'pooled', m, (hi - lo) / 2 FROM sweep, pooled),
predicted AS MATERIALIZED (SELECT era, s.entity, s.q, predictor, centre, half, y FROM bands JOIN sweep s USING (query_id) SEMI JOIN near USING (query_id) JOIN outcomes5 o ON o.entity = s.entity AND o.session_idx = s.q WHERE y IS NOT NULL AND half IS NOT NULL)"""
_SCORES = f"""{_ROWS}, usable AS (SELECT *, abs(y - centre) / half AS off FROM predicted WHERE half > 0),
lists AS (SELECT predictor, list_sort(list(off)) AS s, (count(*) - 1) * least(1, ceil((count(*) + 1) * CAST(0.8 AS DOUBLE)) / count(*)) AS place FROM usable WHERE era = 'calibration' GROUP BY predictor),
scales AS (SELECT predictor, s[CAST(floor(place) AS INT) + 1] + (s[CAST(ceil(place) AS INT) + 1] - s[CAST(floor(place) AS INT) + 1]) * (place - floor(place)) AS scale FROM lists),
scaled AS (SELECT u.*, CASE WHEN predictor IN ('analog_raw', 'own_past') THEN 1 ELSE scale END AS scale FROM usable u LEFT JOIN scales USING (predictor) WHERE era = 'test')"""


def _sweep(p: Panel) -> DataFrame:
    each = [validation.query_grid(p.features, p.calendar, first, last, STRIDE, HORIZON).select(F.lit(era).alias("era"), "entity", F.col("session_idx").alias("q")) for era, (first, last) in ERAS.items()]
    return reduce(DataFrame.unionByName, each).withColumn("query_id", F.xxhash64("entity", "q"))


def sweep(p: Panel) -> DataFrame:
    """(era, entity, q, query_id): the queries of both eras."""
    return p.once("sweep", _sweep)


def _states(p: Panel) -> DataFrame:
    at = sweep(p).join(p.vectors.withColumnRenamed("session_idx", "q"), ["entity", "q"])
    pool = retrieval.batched_pool(p.vectors, at.select("query_id", "z", F.lit(60).alias("j_low"), (F.col("q") - HORIZON).alias("j_high")), K)
    return retrieval.greedy(pool, K).join(followed(p), ["entity", "session_idx"]).select("query_id", "entity", "session_idx", "dist", "y", "mae")


def followed(p: Panel) -> DataFrame:
    """(entity, session_idx, y, mae): what followed every session."""
    return p.once("followed", lambda p: retrieval.outcomes(p.grid, HORIZON).select("entity", "session_idx", F.col("fwd_5").alias("y"), "mae"))


def states(p: Panel) -> DataFrame:
    """(query_id, entity, session_idx, dist, y, mae): the states chosen for each query of the sweep, and what followed; one retrieval answers all."""
    return p.once("sweep-states", _states)


def predicted(p: Panel) -> DataFrame:
    """(era, entity, q, predictor, centre, half, y) of all five predictors for every query with an outcome.

    Queries with under LEAST_RETURNS returns of chosen states are dropped. The pooled band is over every
    outcome realised by the end of the calibration era, of all entities and without a sample.
    """
    return p.once("predicted", _predicted)


def _predicted(p: Panel) -> DataFrame:
    asked = sweep(p)
    quantiles = F.percentile("y", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    near = states(p).groupBy("query_id").agg(quantiles.alias("p"), F.stddev_samp("y").alias("sd"), F.count("y").alias("n")).filter(F.col("n") >= LEAST_RETURNS)
    asked = asked.join(near.select("query_id"), "query_id", "left_semi")
    low, middle, high = (F.col("p")[i] for i in range(3))
    band = lambda name, centre, half: F.struct(F.lit(name).alias("predictor"), centre.cast("double").alias("centre"), half.alias("half"))
    analog = near.select("query_id", F.inline(F.array(band("analog_conformal", middle, F.col("sd")), band("analog_raw", (low + high) / 2, (high - low) / 2))))
    past = distribution.unconditional_band(p.grid, HORIZON, asked.select("entity", "q")).join(asked, ["entity", "q"])
    past = past.select("query_id", F.inline(F.array(band("own_past", F.col("median"), (F.col("hi") - F.col("lo")) / 2))))
    vol = validation.trailing_vol(p.grid).join(asked.withColumnRenamed("q", "session_idx"), ["entity", "session_idx"])
    vol = vol.select("query_id", F.inline(F.array(band("volatility", F.lit(0.0), F.col("sd") * F.sqrt(F.lit(float(HORIZON)))))))
    end = p.calendar.filter(F.col("session_date") <= F.lit(ERAS["calibration"][1]).cast("date")).agg(F.max("session_idx").alias("end"))
    known = followed(p).join(F.broadcast(end), F.col("session_idx") + HORIZON <= F.col("end")).filter("y is not null")
    one = known.agg(quantiles.alias("p"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_POOLED)
    pooled = asked.join(F.broadcast(one)).select("query_id", F.inline(F.array(band("pooled", middle, (high - low) / 2))))  # one row to each query
    bands = reduce(DataFrame.unionByName, [analog, past, vol, pooled])
    own = followed(p).select("entity", F.col("session_idx").alias("q"), "y")
    return bands.join(asked, "query_id").join(own, ["entity", "q"]).filter("y is not null and half is not null").select("era", "entity", "q", "predictor", "centre", "half", "y")


def probed(p: Panel) -> DataFrame:
    """(era, entity, q, date, sector, vol20, y, mae, sigma_h, pit, n_mae, median_mae, p05, p10, p20): each query of the sweep as it is scored.

    pit: share of its states' returns at or under its own; p05 ...: shares of states whose excursion is at
    or beyond each drawdown; sigma_h: its trailing volatility over the horizon. Queries without an
    outcome or with under LEAST_RETURNS returns are left out.
    """
    return p.once("probed", _probed)


def _probed(p: Panel) -> DataFrame:
    own = followed(p).withColumnRenamed("session_idx", "q").filter("y is not null")
    asked = sweep(p).join(own, ["entity", "q"])
    below = (F.col("y") <= F.col("own_y")).cast("int")
    pit = states(p).join(asked.select("query_id", F.col("y").alias("own_y")), "query_id").groupBy("query_id").agg(F.avg(below).alias("pit"), F.count("y").alias("n")).filter(F.col("n") >= LEAST_RETURNS)
    risk = pathrisk.analog_risk(states(p), ["query_id"])
    vol = validation.trailing_vol(p.grid).select("entity", F.col("session_idx").alias("q"), (F.col("sd") * F.sqrt(F.lit(float(HORIZON)))).alias("sigma_h"))
    state = p.features.select("entity", F.col("session_idx").alias("q"), F.col("session_date").alias("date"), F.col("vol20").cast("double").alias("vol20"))
    met = asked.join(pit, "query_id").join(risk, "query_id").join(vol, ["entity", "q"], "left").join(state, ["entity", "q"])
    sector = F.substring("entity", 7, 1)  # the first digit of a brand's code
    return met.select("era", "entity", "q", "date", sector.alias("sector"), "vol20", "y", "mae", "sigma_h", "pit", "n_mae", "median_mae", *map(pathrisk.level_name, pathrisk.LEVELS))


@query(f"{_ROWS} SELECT era, entity, q, predictor, round(centre, 6) + 0 AS centre, round(half, 6) AS half, round(y, 6) AS y FROM predicted")
def predictor_rows(p: Panel) -> DataFrame:
    """Centre and unscaled half-width of each predictor for each query of the sweep, and what followed."""
    return predicted(p)


@query(f"{_SCORES} SELECT predictor, round(any_value(scale), 5) AS scale, count(*) AS n, round(avg(CASE WHEN off <= scale THEN 1 ELSE 0 END), 5) AS coverage, round(avg(2 * half * scale), 5) AS width FROM scaled GROUP BY predictor", 5)
def predictor_scores(p: Panel) -> DataFrame:
    """Out-of-sample coverage and width of the five predictors, each with the multiplier frozen on the calibration era."""
    return validation.frozen_scores(predicted(p))


@query(f"{_ROWS} SELECT predictor, count(*) AS n, round(avg(CASE WHEN sign(y) = sign(centre) THEN 1 ELSE 0 END), 6) AS hit_rate FROM predicted WHERE era = 'test' GROUP BY predictor")
def predictor_direction(p: Panel) -> DataFrame:
    """Share of test queries whose outcome has the sign of the predicted centre."""
    rows = predicted(p).filter("era = 'test'")
    return rows.groupBy("predictor").agg(F.count("*").alias("n"), F.avg((F.signum("y") == F.signum("centre")).cast("int")).alias("hit_rate"))


@query(f"{_SCORES} SELECT entity, count(*) AS n, round(avg(CASE WHEN off <= scale THEN 1 ELSE 0 END), 6) AS coverage, round(avg(2 * half * scale), 6) AS width FROM scaled WHERE predictor = 'own_past' GROUP BY entity")
def own_past_by_symbol(p: Panel) -> DataFrame:
    """Coverage and width of the own-past predictor by entity."""
    rows = predicted(p).filter("predictor = 'own_past' and era = 'test' and half > 0")
    hit = (F.abs(F.col("y") - F.col("centre")) <= F.col("half")).cast("int")
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.avg(hit).alias("coverage"), F.avg(2 * F.col("half")).alias("width"))
