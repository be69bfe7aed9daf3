"""Queries over what followed each state: distributions, bands, stress paths, closed hours, breadth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import closed, distribution, retrieval, sentiment, stress, validation
from .queries import _ASKED, _FOUND, _GREEDY, _POOL, HORIZON, chosen, query, r
from .tables import Panel


def outcomes5(p: Panel) -> DataFrame:
    return retrieval.outcomes(p.grid, HORIZON).select("entity", "session_idx", F.col("fwd_5").alias("y"), "mae", "mfe")


# --- distributions ------------------------------------------------------------------------------

_SUMMARY = ["mean", "sd", "skew", "min", "max", "p05", "p10", "p25", "p50", "p75", "p90", "p95", "prob_m20", "prob_00", "prob_10", "iqr", "width80", "var90"]
_QUANTILES = ", ".join(f"quantile_cont(y, {x / 100}) AS p{x:02d}" for x in (5, 10, 25, 50, 75, 90, 95))


@query(f"""WITH d AS (SELECT entity, count(y) AS n, avg(y) AS mean, stddev_samp(y) AS sd, (avg(y * y * y) - 3 * avg(y) * avg(y * y) + 2 * power(avg(y), 3)) / power(var_pop(y), 1.5) AS skew, min(y) AS min, max(y) AS max, {_QUANTILES},
avg(CASE WHEN y < -0.2 THEN 1 ELSE 0 END) AS prob_m20, avg(CASE WHEN y > 0 THEN 1 ELSE 0 END) AS prob_00, avg(CASE WHEN y < 0.1 THEN 1 ELSE 0 END) AS prob_10 FROM outcomes5 WHERE y IS NOT NULL GROUP BY entity), e AS (SELECT *, p75 - p25 AS iqr, p90 - p10 AS width80, -p10 AS var90 FROM d)
SELECT entity, n, {r(*_SUMMARY, digits=5)} FROM e""", 5)
def distribution_summary(p: Panel) -> DataFrame:
    return distribution.summarize(outcomes5(p), ["entity"], "y").select("entity", "n", *_SUMMARY)


@query("WITH q AS (SELECT entity, quantile_cont(y, 0.1) AS cut FROM outcomes5 GROUP BY entity) SELECT entity, round(-avg(y), 6) AS cvar90, count(*) AS n_tail FROM outcomes5 JOIN q USING (entity) WHERE y <= cut GROUP BY entity")
def tail_mean(p: Panel) -> DataFrame:
    return distribution.tail_mean(outcomes5(p), ["entity"], "y")


_BREACH = ", ".join(f"round(avg(CASE WHEN mae < -{t / 100} THEN 1 ELSE 0 END), 6) AS breach_{t:02d}" for t in (5, 10, 15, 20))


@query(f"SELECT entity, count(*) AS n, {_BREACH} FROM outcomes5 WHERE mae IS NOT NULL GROUP BY entity")
def breach_shares(p: Panel) -> DataFrame:
    return distribution.breach_shares(outcomes5(p), ["entity"], "mae")


@query("SELECT entity, round(avg(CASE WHEN mae > -0.1 THEN 1 ELSE 0 END), 6) AS holdable, round(quantile_cont(mae, 0.5), 6) AS mae_median, round(quantile_cont(mfe, 0.5), 6) AS mfe_median, round(abs(quantile_cont(mfe, 0.5) / quantile_cont(mae, 0.5)), 6) AS reward_risk FROM outcomes5 WHERE mae IS NOT NULL GROUP BY entity")
def tail_profile(p: Panel) -> DataFrame:
    return distribution.tail_profile(outcomes5(p).filter("mae is not null"), ["entity"]).select("entity", "holdable", "mae_median", "mfe_median", "reward_risk")


@query("""WITH e AS (SELECT entity, min(y) AS lo, (max(y) - min(y)) / 12 AS step, count(*) AS n FROM outcomes5 WHERE y IS NOT NULL GROUP BY entity),
c AS (SELECT entity, least(11, CAST(floor((y - lo) / step) AS INT)) AS bin, count(*) AS count FROM outcomes5 JOIN e USING (entity) WHERE y IS NOT NULL GROUP BY ALL)
SELECT entity, CAST(b.bin AS INT) AS bin, round(lo + b.bin * step, 6) AS x0, round(lo + (b.bin + 1) * step, 6) AS x1, coalesce(c.count, 0) AS count, round(coalesce(c.count, 0) / n, 6) AS share FROM e CROSS JOIN range(12) b(bin) LEFT JOIN c USING (entity, bin)""")
def histogram(p: Panel) -> DataFrame:
    return distribution.histogram(outcomes5(p), ["entity"], "y", 12)


@query("""WITH g AS (SELECT entity, list_sort(list(abs(y))) AS s, count(*) AS n, least(1.0, ceil((count(*) + 1) * 0.8::DOUBLE) / count(*)) AS level FROM outcomes5 WHERE y IS NOT NULL GROUP BY entity), a AS (SELECT *, (n - 1) * level AS place FROM g)
SELECT entity, n, round(level, 6) AS level, round(s[CAST(floor(place) AS INT) + 1] + (s[CAST(ceil(place) AS INT) + 1] - s[CAST(floor(place) AS INT) + 1]) * (place - floor(place)), 6) AS scale FROM a""")
def conformal_scale(p: Panel) -> DataFrame:
    return distribution.conformal_scale(outcomes5(p).withColumn("score", F.abs("y")), ["entity"], "score")


@query("""WITH q AS (SELECT DISTINCT entity, session_idx AS q FROM grid WHERE a IS NOT NULL)
SELECT entity, CAST(q AS INT) AS q, count(*) AS n, round(quantile_cont(y, 0.1), 6) AS lo, round(quantile_cont(y, 0.9), 6) AS hi, round(quantile_cont(y, 0.5), 6) AS median FROM q JOIN outcomes5 USING (entity) WHERE session_idx + 5 <= q AND y IS NOT NULL GROUP BY ALL HAVING count(*) >= 30""")
def unconditional_band(p: Panel) -> DataFrame:
    """The band of every session with a bar."""
    return distribution.unconditional_band(p.grid, HORIZON, p.grid.filter("a is not null").select("entity", F.col("session_idx").alias("q")))


_HELD = """held AS (SELECT g.entity, g.q, quantile_cont(o.y, 0.1) AS lo, quantile_cont(o.y, 0.9) AS hi, quantile_cont(o.y, 0.5) AS median, any_value(f.y) AS y
FROM (SELECT DISTINCT entity, session_idx AS q FROM grid WHERE a IS NOT NULL) g JOIN outcomes5 o ON o.entity = g.entity AND o.session_idx + 5 <= g.q AND o.y IS NOT NULL
JOIN outcomes5 f ON f.entity = g.entity AND f.session_idx = g.q AND f.y IS NOT NULL GROUP BY g.entity, g.q HAVING count(*) >= 30)"""


def held(p: Panel) -> DataFrame:
    """Predictions that are scored: the unconditional band and median of every session, and what followed."""
    followed = outcomes5(p).filter("y is not null").select("entity", F.col("session_idx").alias("q"), "y")
    return unconditional_band(p).join(followed, ["entity", "q"])


@query(f"WITH {_HELD} SELECT entity, count(*) AS n, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1 ELSE 0 END), 6) AS coverage, round(avg(hi - lo), 6) AS width FROM held GROUP BY entity HAVING count(*) >= 10")
def unconditional_by_symbol(p: Panel) -> DataFrame:
    return validation.by_symbol(held(p))


@query(f"WITH {_HELD} SELECT entity, count(*) AS n, round(avg(CASE WHEN sign(y) = sign(median) THEN 1 ELSE 0 END), 6) AS hit_rate FROM held GROUP BY entity")
def unconditional_direction(p: Panel) -> DataFrame:
    return validation.directional(held(p), ["entity"])


@query(f"""WITH RECURSIVE {_ASKED}, {_FOUND}, {_POOL}, {_GREEDY},
k AS (SELECT entity, session_idx, CAST(year(session_date) AS VARCHAR) AS y FROM chosen JOIN calendar USING (session_idx)),
e AS (SELECT 'entity' AS kind, entity AS value, * FROM k UNION ALL SELECT 'year', y, * FROM k UNION ALL SELECT 'all', 'all', * FROM k)
SELECT kind, value, count(*) AS n, count(DISTINCT session_idx) AS n_sessions, count(DISTINCT entity) AS n_entities FROM e GROUP BY kind, value""")
def chosen_groups(p: Panel) -> DataFrame:
    return retrieval.group_counts(chosen(p).select("entity", "session_idx"), p.calendar.select("session_idx", "session_date"))


# --- stress -------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_ASKED}, {_FOUND}, {_POOL}, {_GREEDY}
SELECT CAST(0 AS BIGINT) AS query_id, CAST(t AS INT) AS t, count(*) AS n, {', '.join(f'round(quantile_cont(f.a / g.a - 1, {x / 100}), 6) AS p{x}' for x in (10, 25, 50, 75, 90))}
FROM chosen JOIN grid g USING (entity, session_idx), range(1, 6) s(t) JOIN grid f ON f.entity = chosen.entity AND f.session_idx = chosen.session_idx + t WHERE g.a > 0 AND f.a > 0 GROUP BY t""")
def path_fan(p: Panel) -> DataFrame:
    """What followed the states that the retrieval chose, step by step."""
    return stress.path_fan(chosen(p), p.grid, HORIZON)



@query("""WITH RECURSIVE w AS (SELECT session_idx AS j, y AS ret, row_number() OVER (ORDER BY y, session_idx) AS rn FROM outcomes5, bench WHERE entity = b AND y IS NOT NULL),
k AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS INT[]) AS kept UNION ALL SELECT w.rn, CASE WHEN len(kept) < 10 AND len(list_filter(kept, lambda x: abs(x - j) < 20)) = 0 THEN list_append(kept, j) ELSE kept END FROM k JOIN w ON w.rn = k.rn + 1)
SELECT j, round(ret, 6) AS ret FROM w WHERE list_contains((SELECT kept FROM k ORDER BY rn DESC LIMIT 1), j)""")
def worst_windows(p: Panel) -> DataFrame:
    return stress.worst_windows(p.grid, p.benchmark, HORIZON, 10, 20)


# --- validation ---------------------------------------------------------------------------------


@query("""WITH x AS (SELECT entity, session_idx, CASE WHEN a > 0 AND lag(a) OVER (w) > 0 THEN ln(a / lag(a) OVER (w)) END AS lr FROM grid WINDOW w AS (PARTITION BY entity ORDER BY session_idx))
SELECT entity, session_idx, round(CASE WHEN count(lr) OVER v >= 20 THEN stddev_samp(lr) OVER v END, 6) AS sd FROM x WINDOW v AS (PARTITION BY entity ORDER BY session_idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def trailing_vol(p: Panel) -> DataFrame:
    return validation.trailing_vol(p.grid)


# --- closed hours -------------------------------------------------------------------------------


@query(f"SELECT instrument, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {r('c', 'hi', 'lo', 'qv')} FROM candles")
def hourly_candles(p: Panel) -> DataFrame:
    return p.hourly


@query("""SELECT instrument, count(*) + 1 AS hours, round(100 * avg(CASE WHEN open THEN 0 ELSE 1 END), 6) AS closed_hours_pct, round(100 * sum(CASE WHEN open THEN 0 ELSE abs(ret) END) / sum(abs(ret)), 6) AS closed_move_pct,
round(100 * avg(CASE WHEN NOT open THEN CAST(traded AS INT) END), 6) AS traded_outside_pct, round(100 * avg(CASE WHEN open THEN CAST(traded AS INT) END), 6) AS traded_inside_pct, round(stddev_samp(CASE WHEN NOT open THEN ret END) / stddev_samp(CASE WHEN open THEN ret END), 6) AS sd_ratio FROM moves GROUP BY instrument""")
def closed_hours(p: Panel) -> DataFrame:
    return closed.closed_hours(p.hourly)


@query(f"SELECT instrument, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS end_ts, hours, kind, {r('entry', 'exit', 'return_pct', 'mae_pct', 'mfe_pct', digits=5)} FROM blocks", 5)
def closed_blocks(p: Panel) -> DataFrame:
    return closed.closed_blocks(p.hourly)


@query("SELECT kind, count(*) AS n, count(DISTINCT start_ts) AS n_starts, round(quantile_cont(return_pct, 0.5), 5) AS median_return, round(quantile_cont(mae_pct, 0.5), 5) AS median_mae, round(100 * avg(CASE WHEN mae_pct <= -5 THEN 1 ELSE 0 END), 5) AS breach5_pct FROM blocks GROUP BY kind", 5)
def pooled_blocks(p: Panel) -> DataFrame:
    return closed.pool_blocks(closed.closed_blocks(p.hourly))


# --- sentiment ----------------------------------------------------------------------------------


@query("WITH m AS (SELECT entity, session_idx, c, avg(c) OVER (PARTITION BY entity ORDER BY session_idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS mean FROM grid) SELECT count(*) AS n, round(100 * avg(CASE WHEN c > mean THEN 1 ELSE 0 END), 6) AS breadth FROM m WHERE session_idx = (SELECT max(session_idx) FROM grid) AND mean IS NOT NULL")
def breadth50(p: Panel) -> DataFrame:
    return sentiment.breadth(p.grid, 50)


@query("WITH l AS (SELECT series_id, arg_max(value, obs_date) AS latest FROM series GROUP BY series_id) SELECT series_id, round(any_value(latest), 6) AS latest, round(100 * sum(CASE WHEN value < latest THEN 1 ELSE 0 END) / greatest(1, count(*) - 1), 6) AS percentile FROM series JOIN l USING (series_id) GROUP BY series_id")
def latest_percentile(p: Panel) -> DataFrame:
    return sentiment.latest_percentile(p.series, rows=None)


@query("""WITH i AS (SELECT event_id AS pos, event_type || ' ' || user_id % 40 || '!' AS title, ts AS published_at FROM events),
k AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(title), '[^a-z0-9一-龥]+', ' ', 'g')) ORDER BY pos) = 1)
SELECT pos, title, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, CAST(row_number() OVER (ORDER BY published_at DESC NULLS LAST, pos) AS INT) AS rank FROM k QUALIFY rank <= 30""")
def ranked_headlines(p: Panel) -> DataFrame:
    items = p.table("events").select(F.col("event_id").alias("pos"), F.concat("event_type", F.lit(" "), (F.col("user_id") % 40).cast("string"), F.lit("!")).alias("title"), F.col("ts").alias("published_at"))
    return sentiment.rank_headlines(items, 30)
