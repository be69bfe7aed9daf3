"""Scores of the sweep's predictions: bands out of sample, path risk, reliability and their uncertainty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import distribution, pathrisk, validation
from ..operators.pathrisk import LEAST_OWN, LEVELS, PREDICTORS, RESAMPLES, SEED
from .predictors import _ROWS, _SCORES, LEAST_RETURNS, predicted, probed
from .queries import query
from .tables import Panel

_SHARES = ", ".join(f"avg(CASE WHEN mae <= -{level} THEN 1 WHEN mae > -{level} THEN 0 END) AS {pathrisk.level_name(level)}" for level in LEVELS)
_PROBED = f"""risk AS (SELECT query_id, count(y) AS n_y, count(mae) AS n_mae, quantile_cont(mae, 0.5) AS median_mae, {_SHARES} FROM states JOIN outcomes5 USING (entity, session_idx) GROUP BY query_id HAVING count(y) >= {LEAST_RETURNS}),
pits AS (SELECT w.query_id, avg(CASE WHEN o.y <= f.y THEN 1 ELSE 0 END) AS pit FROM sweep w JOIN outcomes5 f ON f.entity = w.entity AND f.session_idx = w.q JOIN states s ON s.query_id = w.query_id JOIN outcomes5 o ON o.entity = s.entity AND o.session_idx = s.session_idx WHERE o.y IS NOT NULL GROUP BY w.query_id),
probed AS MATERIALIZED (SELECT s.era, s.entity, s.q, f.session_date AS date, substr(s.entity, 7, 1) AS sector, CAST(vol20 AS DOUBLE) AS vol20, o.y, o.mae, v.sd * sqrt(CAST(5 AS DOUBLE)) AS sigma_h, pit, n_mae, median_mae, {", ".join(map(pathrisk.level_name, LEVELS))}
FROM sweep s JOIN risk USING (query_id) JOIN pits USING (query_id) JOIN outcomes5 o ON o.entity = s.entity AND o.session_idx = s.q JOIN features f ON f.entity = s.entity AND f.session_idx = s.q LEFT JOIN vol v ON v.entity = s.entity AND v.session_idx = s.q WHERE o.y IS NOT NULL)"""
_CDF = "(0.5 * (1 + CASE WHEN {0} >= 0 THEN 1 ELSE -1 END * (1 - (((((1.061405429 * {1} - 1.453152027) * {1}) + 1.421413741) * {1} - 0.284496736) * {1} + 0.254829592) * {1} * exp(-{0} * {0} / 2))))"
_T = "(1 / (1 + CAST(0.3275911 AS DOUBLE) * abs(x) / sqrt(CAST(2 AS DOUBLE))))"
_RISK = f"""{_ROWS}, {_PROBED},
breach AS MATERIALIZED (SELECT level, era, entity, q, CASE WHEN mae <= -level THEN 1 WHEN mae > -level THEN 0 END AS y, analog_mae, vol_reflection, CASE WHEN mae IS NULL THEN 'no_path' WHEN analog_mae IS NULL THEN 'no_excursion' WHEN vol_reflection IS NULL THEN 'no_volatility' END AS reason FROM (
  SELECT *, CASE WHEN sigma_h > 0 THEN least(1, 2 * {_CDF.format("x", _T)}) END AS vol_reflection FROM ({" UNION ALL ".join(f"SELECT era, entity, q, mae, sigma_h, {level}::DOUBLE AS level, {pathrisk.level_name(level)} AS analog_mae, -{level}::DOUBLE / nullif(sigma_h, 0) AS x FROM probed" for level in LEVELS)}))),
owns AS (SELECT level, entity, count(*) AS n_own, avg(y) AS rate FROM breach WHERE era = 'calibration' AND y IS NOT NULL GROUP BY ALL), rates AS (SELECT level, avg(y) AS pooled FROM breach WHERE era = 'calibration' AND y IS NOT NULL GROUP BY level),
risks AS MATERIALIZED (SELECT b.level, b.entity, q, b.y, analog_mae, vol_reflection, CASE WHEN n_own >= {LEAST_OWN} THEN rate ELSE pooled END AS same_name, pooled, coalesce(n_own < {LEAST_OWN}, true) AS fallback FROM breach b JOIN rates USING (level) LEFT JOIN owns o ON o.level = b.level AND o.entity = b.entity WHERE era = 'test' AND reason IS NULL),
longs AS MATERIALIZED (UNPIVOT (SELECT level, entity, q, y, {", ".join(f"CAST({k} AS DOUBLE) AS {k}" for k in PREDICTORS)} FROM risks) ON {", ".join(PREDICTORS)} INTO NAME predictor VALUE p)"""
_CUTS = "cuts AS (SELECT list_sort(list(vol20)) AS s FROM probed WHERE era = 'test' AND vol20 IS NOT NULL), t AS (SELECT s[CAST(floor((len(s) - 1) * (1 / CAST(3 AS DOUBLE))) AS INT) + 1] AS low, s[CAST(floor((len(s) - 1) * (2 / CAST(3 AS DOUBLE))) AS INT) + 1] AS high FROM cuts)"
_SLICED = f"{_SCORES}, {_PROBED}, {_CUTS}, placed AS MATERIALIZED (SELECT s.*, f.sector, CAST(year(f.date) AS VARCHAR) AS year, f.vol20, CASE WHEN f.vol20 <= low THEN 'low' WHEN f.vol20 <= high THEN 'mid' WHEN f.vol20 IS NOT NULL THEN 'high' END AS regime FROM scaled s JOIN probed f ON f.era = 'test' AND f.entity = s.entity AND f.q = s.q, t)"
_HIT = "avg(CASE WHEN off <= scale THEN 1 ELSE 0 END)"


def bands(p: Panel) -> DataFrame:
    return p.once("bands", lambda p: validation.frozen_bands(predicted(p)))


def breaches(p: Panel) -> DataFrame:
    return p.once("breaches", lambda p: pathrisk.breach_rows(probed(p)))


def risks(p: Panel) -> DataFrame:
    return p.once("risks", lambda p: pathrisk.predictions(breaches(p)))


def placed(p: Panel) -> DataFrame:
    """``bands`` with each query's sector, year, volatility and its regime among the test queries."""
    test = probed(p).filter("era = 'test'")
    cuts = validation.floor_cuts(test, "vol20", (1 / 3, 2 / 3))
    own = test.join(F.broadcast(cuts)).select("entity", "q", "sector", F.year("date").cast("string").alias("year"), "vol20", validation.regime(F.col("vol20"), F.col("cuts")).alias("regime"))
    return bands(p).join(own, ["entity", "q"]).withColumns({"hit": F.col("off") <= F.col("scale"), "width": 2 * F.col("half") * F.col("scale")})


# --- bands --------------------------------------------------------------------------------------


@query(f"{_SCORES} SELECT predictor, count(*) AS n, round({_HIT}, 6) AS coverage, round(avg(2 * half * scale), 6) AS width, round(avg(y - centre), 6) + 0 AS bias, round(avg(CASE WHEN y > centre + half * scale THEN 1 ELSE 0 END), 6) AS above, round(avg(CASE WHEN y < centre - half * scale THEN 1 ELSE 0 END), 6) AS below FROM scaled GROUP BY predictor")
def band_scores(p: Panel) -> DataFrame:
    """Coverage, width, bias and tails of the five predictors' bands on the test era."""
    return distribution.band_scores(bands(p), ["predictor"])


@query(f"{_SCORES} SELECT CAST(i AS DOUBLE) / 10 AS level, round(avg(CASE WHEN abs(y - centre) <= half * scale * (CAST(i AS DOUBLE) / 10) THEN 1 ELSE 0 END), 6) AS empirical, count(*) AS n FROM scaled, range(1, 10) t(i) WHERE predictor = 'analog_conformal' GROUP BY i")
def reliability(p: Panel) -> DataFrame:
    """Share of outcomes inside the analogs' band shrunk to nine levels."""
    return distribution.reliability(bands(p).filter("predictor = 'analog_conformal'"))


@query(f"{_SCORES}, c AS (SELECT predictor, q, avg(CASE WHEN off <= scale THEN 1 ELSE 0 END) AS m, sum(CASE WHEN off <= scale THEN 1 ELSE 0 END) AS s, count(*) AS k FROM scaled GROUP BY ALL) SELECT predictor, CAST(sum(k) AS BIGINT) AS n, round(sum(s) / sum(k), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS se, count(*) AS clusters FROM c GROUP BY predictor")
def clustered_error(p: Panel) -> DataFrame:
    """Coverage of each predictor with an error clustered by query session."""
    return validation.clustered(bands(p).withColumn("hit", (F.col("off") <= F.col("scale")).cast("int")), ["predictor"], "q", "hit")


@query(f"{_ROWS}, {_PROBED}, c AS (SELECT least(9, CAST(floor(pit * 10) AS INT)) AS decile, count(*) AS n FROM probed WHERE era = 'test' GROUP BY 1), t AS (SELECT sum(n) / 10 AS e FROM c) SELECT CAST(i AS INT) AS decile, coalesce(n, 0) AS n, round(power(coalesce(n, 0) - e, 2) / e, 6) AS chi_part FROM range(10) r(i) LEFT JOIN c ON decile = i, t")
def pit_deciles(p: Panel) -> DataFrame:
    """Where test outcomes fall among the returns of their chosen states."""
    return validation.pit_deciles(probed(p).filter("era = 'test'"))


_SLICE = "SELECT predictor, '{0}' AS slice, {0} AS value, count(*) AS n, round(" + _HIT + ", 6) AS coverage, round(avg(2 * half * scale), 6) AS width FROM placed WHERE {0} IS NOT NULL GROUP BY predictor, {0}"


@query(f"{_SLICED} {' UNION ALL '.join(_SLICE.format(s) for s in ('regime', 'year', 'sector'))}")
def coverage_slices(p: Panel) -> DataFrame:
    """Coverage and width by volatility regime, by year and by sector."""
    return validation.by_slice(placed(p), ["regime", "year", "sector"], "predictor", "hit", "width")


_BY_SYMBOL = f"{_SLICED}, symbols AS (SELECT predictor, entity, count(*) AS n, {_HIT} AS coverage, avg(2 * half * scale) AS width, avg(vol20) AS vol FROM placed GROUP BY predictor, entity HAVING count(*) >= 10)"


def by_symbol(p: Panel) -> DataFrame:
    rows = placed(p).groupBy("predictor", "entity").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("int")).alias("coverage"), F.avg("width").alias("width"), F.avg("vol20").alias("vol"))
    return rows.filter("n >= 10")


@query(f"{_BY_SYMBOL} SELECT predictor, entity, n, round(coverage, 6) AS coverage, round(width, 6) AS width, round(vol, 6) AS vol FROM symbols")
def predictors_by_symbol(p: Panel) -> DataFrame:
    """Coverage, width and mean volatility of every predictor by entity."""
    return by_symbol(p)


@query(f"{_BY_SYMBOL} SELECT predictor, count(*) AS n, round(stddev_samp(coverage), 5) AS sd, round(min(coverage), 5) AS min, round(max(coverage), 5) AS max, sum(CASE WHEN abs(coverage - 0.8) <= 0.1 THEN 1 ELSE 0 END)::BIGINT AS within, round(CASE WHEN stddev_pop(width) > 1e-9 THEN corr(width, vol) END, 5) AS corr, round(quantile_cont(coverage, 0.75) - quantile_cont(coverage, 0.25), 5) AS iqr FROM symbols GROUP BY predictor", 5)
def symbol_dispersion(p: Panel) -> DataFrame:
    """How coverage spreads over entities, and whether widths follow volatility (null where widths are one constant)."""
    out = validation.dispersion(by_symbol(p), ["predictor"], "coverage", "width", "vol", 0.8)
    return out.select("predictor", "n", "sd", "min", "max", "within", "corr", "iqr")


@query(f"{_SCORES}, r AS (SELECT predictor, list_sort(list(off)) AS s, count(*) AS n FROM usable WHERE era = 'test' GROUP BY predictor), m AS (SELECT predictor, n, greatest(CAST(0.05 AS DOUBLE), least(20, s[CAST(ceil(CAST(0.8 AS DOUBLE) * n) AS INT)])) AS multiplier FROM r) SELECT predictor, any_value(n) AS n, round(any_value(multiplier), 6) AS multiplier, round(avg(CASE WHEN off <= multiplier THEN 1 ELSE 0 END), 6) AS coverage, round(avg(2 * half * multiplier), 6) AS width FROM m JOIN usable USING (predictor) WHERE era = 'test' GROUP BY predictor")
def matched_multiplier(p: Panel) -> DataFrame:
    """Each predictor's width once all cover the same share of test outcomes."""
    rows = predicted(p).filter("era = 'test'").withColumn("miss", F.abs(F.col("y") - F.col("centre")))
    return validation.matched_multiplier(rows, ["predictor"], "miss", "half")


@query(f"{_SCORES}, r AS (SELECT predictor, list_sort(list(off)) AS s, count(*) AS n FROM usable WHERE era = 'calibration' GROUP BY predictor), m AS (SELECT predictor, n, greatest(CAST(0.05 AS DOUBLE), least(20, s[CAST(ceil(CAST(0.8 AS DOUBLE) * n) AS INT)])) AS multiplier FROM r), w AS (SELECT predictor, round(avg(2 * half * multiplier), 6) AS width FROM m JOIN usable USING (predictor) WHERE era = 'calibration' GROUP BY predictor) SELECT predictor, width, CAST(row_number() OVER (ORDER BY width, predictor) AS INT) AS place FROM w")
def predictor_selection(p: Panel) -> DataFrame:
    """Predictors in order of their matched width on the calibration era, which alone may choose."""
    from pyspark.sql import Window

    rows = predicted(p).filter("era = 'calibration'").withColumn("miss", F.abs(F.col("y") - F.col("centre")))
    widths = validation.matched_multiplier(rows, ["predictor"], "miss", "half").select("predictor", F.round("width", 6).alias("width"))
    return widths.withColumn("place", F.row_number().over(Window.orderBy("width", "predictor")))  # five rows


# --- path risk ----------------------------------------------------------------------------------


@query(f"{_RISK} SELECT level, entity, CAST(q AS INT) AS q, y, round(analog_mae, 6) AS analog_mae, round(vol_reflection, 6) AS vol_reflection, round(same_name, 6) AS same_name, round(pooled, 6) AS pooled, fallback FROM risks")
def path_risk_rows(p: Panel) -> DataFrame:
    """Four predictors' probability that a test query's path breaches each drawdown, and whether it did."""
    return risks(p)


@query(f"{_RISK} SELECT level, coalesce(reason, 'used') AS reason, count(*) AS n FROM breach WHERE era = 'test' GROUP BY ALL")
def path_risk_dropped(p: Panel) -> DataFrame:
    """Test queries that path risk can't score, counted by reason."""
    return pathrisk.dropped(breaches(p))


_RANKS = "ranks AS (SELECT *, rank() OVER (PARTITION BY level, predictor ORDER BY p) + (count(*) OVER (PARTITION BY level, predictor, p) - 1) / 2 AS rk FROM longs), aucs AS (SELECT level, predictor, sum(y) AS pos, count(*) - sum(y) AS neg, (sum(y * rk) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM ranks GROUP BY ALL)"


@query(f"""{_RISK}, {_RANKS}, c AS (SELECT level, predictor, q, avg(power(p - y, 2)) AS m, sum(power(p - y, 2)) AS s, count(*) AS k FROM longs GROUP BY ALL), e AS (SELECT level, predictor, CAST(sum(k) AS BIGINT) AS n, sum(s) / sum(k) AS brier, stddev_samp(m) / sqrt(count(*)) AS se, count(*) AS clusters FROM c GROUP BY ALL),
w AS (SELECT level, predictor, avg(p) AS p_mean, avg(CASE WHEN y = 1 THEN p END) AS p_event, avg(CASE WHEN y = 0 THEN p END) AS p_none FROM longs GROUP BY ALL)
SELECT level, predictor, n, round(brier, 6) AS brier, round(se, 6) AS se, clusters, round(p_event, 6) AS p_event, round(p_none, 6) AS p_none, round(p_mean, 6) AS p_mean, round(auc, 6) AS auc FROM e JOIN w USING (level, predictor) JOIN aucs USING (level, predictor)""")
def path_risk_scores(p: Panel) -> DataFrame:
    """Brier score with a clustered error, AUC and mean probabilities of the four predictors at each drawdown."""
    return pathrisk.scores(risks(p))


@query(f"{_RISK} SELECT level, predictor, count(*) AS n, round(avg(power(p - y, 2)), 6) AS brier, round(avg(CASE WHEN y = 1 THEN p END), 6) AS p_event, round(avg(CASE WHEN y = 0 THEN p END), 6) AS p_none FROM longs GROUP BY ALL")
def brier_score(p: Panel) -> DataFrame:
    return validation.brier(pathrisk.by_predictor(risks(p)), ["level", "predictor"], "p", "y")


@query(f"{_RISK}, {_RANKS} SELECT level, predictor, CAST(pos AS BIGINT) AS n_pos, CAST(neg AS BIGINT) AS n_neg, round(auc, 6) AS auc FROM aucs")
def auc(p: Panel) -> DataFrame:
    return validation.auc(pathrisk.by_predictor(risks(p)), ["level", "predictor"], "p", "y")


@query(f"{_RISK} SELECT level, CASE WHEN analog_mae < 0.05 THEN 0 WHEN analog_mae < 0.1 THEN 1 WHEN analog_mae < 0.2 THEN 2 WHEN analog_mae < 0.35 THEN 3 WHEN analog_mae < 0.5 THEN 4 WHEN analog_mae < 0.7 THEN 5 ELSE 6 END AS bin, count(*) AS n, round(avg(analog_mae), 6) AS mean_p, round(avg(y), 6) AS rate FROM risks GROUP BY ALL")
def path_reliability(p: Panel) -> DataFrame:
    """The analogs' probability in seven bins against how often the path breached."""
    return validation.path_reliability(risks(p), ["level"], "analog_mae", "y")


@query(f"{_RISK}, k AS (SELECT entity, count(*) AS n, avg(y) AS rate, sum(y) AS s FROM breach WHERE era = 'calibration' AND level = 0.2 AND y IS NOT NULL GROUP BY entity) SELECT entity, n, round(CASE WHEN n >= 10 THEN rate ELSE (SELECT sum(s) / sum(n) FROM k) END, 6) AS rate FROM k")
def fallback_rate(p: Panel) -> DataFrame:
    """An entity's own breach rate of the calibration era at the deepest drawdown, the pooled one if it has few rows."""
    return validation.fallback_rate(breaches(p).filter("era = 'calibration' and level = 0.2 and y is not null"), "y")


@query(f"{_RISK}, c AS (SELECT level, q, avg(analog_mae - y) AS m, count(*) AS k FROM risks GROUP BY ALL), e AS (SELECT level, stddev_samp(m) / sqrt(count(*)) AS se FROM c GROUP BY level) SELECT level, count(*) AS n, round(avg(analog_mae), 6) AS predicted, round(avg(y), 6) AS realised, round(avg(analog_mae - y), 6) + 0 AS gap, round(any_value(se), 6) AS se FROM risks JOIN e USING (level) GROUP BY level")
def breach_calibration(p: Panel) -> DataFrame:
    """The analogs' mean probability of a breach against the share of paths that breached."""
    return pathrisk.breach_calibration(risks(p))


_SUMS = ", ".join(f"sum(power({k} - y, 2)) AS {k}" for k in PREDICTORS)


def _differences(of: str) -> str:
    return " UNION ALL ".join(f"SELECT level, '{k}' AS predictor, (analog_mae - {k}) / n AS d FROM {of}" for k in PREDICTORS[1:])


@query(f"""{_RISK}, per AS MATERIALIZED (SELECT level, q, count(*) AS n, {_SUMS} FROM risks GROUP BY ALL), spots AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY level ORDER BY q) - 1 AS place FROM per), sizes AS (SELECT level, count(*) AS size FROM per GROUP BY level),
turns AS (SELECT level, size, resample, turn FROM sizes, range({RESAMPLES}) a(resample), range(100000) b(turn) WHERE turn < size),
drawn AS (SELECT level, resample, CAST(('0x' || left(md5('{SEED}:' || resample || ':' || turn), 12)) AS BIGINT) % size AS place FROM turns),
each AS (SELECT level, resample, sum(n) AS n, {", ".join(f"sum({k}) AS {k}" for k in PREDICTORS)} FROM drawn JOIN spots USING (level, place) GROUP BY ALL), whole AS (SELECT level, sum(n) AS n, {", ".join(f"sum({k}) AS {k}" for k in PREDICTORS)} FROM per GROUP BY level),
{", ".join(f"{name} AS ({_differences(of)})" for name, of in (("ds", "each"), ("dw", "whole")))}
SELECT level, predictor, round(any_value(dw.d), 6) + 0 AS delta, round(quantile_cont(ds.d, 0.025), 6) + 0 AS low, round(quantile_cont(ds.d, 0.975), 6) + 0 AS high, round(avg(CASE WHEN ds.d < 0 THEN 1 ELSE 0 END), 6) AS share_better FROM ds JOIN dw USING (level, predictor) GROUP BY ALL""")
def cluster_bootstrap(p: Panel) -> DataFrame:
    """Whether the analogs' probabilities beat each other predictor's, by resampling whole query sessions."""
    return pathrisk.paired_bootstrap(risks(p))
