"""DuckDB SQL of the panel's layers, for the oracles: each query takes the layers that it needs."""

from __future__ import annotations

import re

from ..schema import FEATURES, distance_weights
from .tables import SERIES

_ORDER = "ORDER BY l_shipdate, l_orderkey, l_linenumber"
_BY = "PARTITION BY entity ORDER BY session_idx"

#: Name -> (body, layers that it reads).
LAYERS: dict[str, str] = {
    "lines": "SELECT p_brand AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS session_date, l_extendedprice / l_quantity AS u, l_extendedprice / l_quantity * (1 - l_discount) AS net, l_quantity, l_shipdate, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey",
    "bars": f"SELECT entity, session_date, first(u {_ORDER}) AS o, max(u) AS h, min(u) AS l, last(u {_ORDER}) AS c, last(net {_ORDER}) AS a, sum(l_quantity) AS v FROM lines GROUP BY ALL",
    "bench": "SELECT min(p_brand) AS b, (SELECT min(p_brand) FROM part WHERE p_brand > (SELECT min(p_brand) FROM part)) AS g FROM part",
    "calendar": "SELECT CAST(row_number() OVER (ORDER BY session_date) - 1 AS INT) AS session_idx, session_date FROM (SELECT DISTINCT session_date FROM bars, bench WHERE entity = b)",
    "grid": "SELECT e.entity, k.session_idx, k.session_date, o, h, l, c, a, v FROM (SELECT DISTINCT entity FROM bars) e CROSS JOIN calendar k LEFT JOIN bars USING (entity, session_date)",
    "series": " UNION ALL ".join(
        f"SELECT {key} AS series_id, CAST(max(o_orderdate) AS DATE) AS obs_date, avg(o_totalprice) AS value FROM orders GROUP BY {group}date_trunc('month', o_orderdate)"
        for key, group in (("'p:' || o_orderpriority", "o_orderpriority, "), ("'s:' || o_orderstatus", "o_orderstatus, "), ("'all'", ""))
    ),
    "carried": "SELECT s.series_id, k.session_idx, x.value FROM calendar k CROSS JOIN (SELECT DISTINCT series_id FROM series) s ASOF LEFT JOIN series x ON x.series_id = s.series_id AND k.session_date >= x.obs_date",
    "levels": "SELECT session_idx, " + ", ".join(f"max(value) FILTER (WHERE series_id = '{s}') AS {n}" for n, s in SERIES.items()) + " FROM carried GROUP BY session_idx",
    "entity_events": "SELECT entity, min(session_date) AS event_date FROM bars GROUP BY entity, date_trunc('quarter', session_date)",
    "market_events": "SELECT DISTINCT session_idx FROM calendar WHERE EXISTS (SELECT 1 FROM (SELECT unnest(range(0, 7)) AS n) WHERE day(session_date + CAST(n AS INT)) = 1)",
    "snapped": "SELECT e.entity, e.event_date, (SELECT min(session_idx) FROM calendar k WHERE k.session_date >= e.event_date) AS event_idx FROM entity_events e",
    "returns": f"SELECT *, CASE WHEN lag(a) OVER (w) > 0 THEN ln(a / lag(a) OVER (w)) END AS lr, CASE WHEN lag(c) OVER (w) > 0 THEN abs(o / lag(c) OVER (w) - 1) END AS gap, v * c AS dv FROM grid WINDOW w AS ({_BY})",
    "own": f"""SELECT *, CASE WHEN lag(a, 5) OVER (w) <> 0 THEN a / lag(a, 5) OVER (w) - 1 END AS ret5, CAST(CASE WHEN lag(a, 20) OVER (w) <> 0 THEN a / lag(a, 20) OVER (w) - 1 END AS FLOAT) AS ret20,
      CASE WHEN lag(a, 60) OVER (w) <> 0 THEN a / lag(a, 60) OVER (w) - 1 END AS ret60, c / max(h) OVER ({_BY} ROWS 251 PRECEDING) - 1 AS dist52,
      CAST(CASE WHEN session_idx >= 20 THEN stddev_samp(lr) OVER ({_BY} ROWS 19 PRECEDING) * sqrt(252) END AS FLOAT) AS vol20, CASE WHEN session_idx >= 5 THEN stddev_samp(lr) OVER ({_BY} ROWS 4 PRECEDING) * sqrt(252) END AS vol5,
      a / max(a) OVER ({_BY} ROWS 59 PRECEDING) - 1 AS dd60, avg(gap) OVER ({_BY} ROWS 19 PRECEDING) AS gap20, CASE WHEN session_idx >= 19 THEN avg(dv) OVER ({_BY} ROWS 19 PRECEDING) END AS dv20
      FROM returns WINDOW w AS ({_BY})""",
    "liquid": f"SELECT *, avg(CASE WHEN session_idx >= 20 THEN dv20 END) OVER w AS dv_mean, stddev_samp(CASE WHEN session_idx >= 20 THEN dv20 END) OVER w AS dv_sd FROM own WINDOW w AS ({_BY} ROWS BETWEEN 249 PRECEDING AND 20 PRECEDING)",
    "market": """SELECT m.session_idx, m.ret20d AS mkt_ret20, CASE WHEN m.session_idx >= 20 THEN stddev_samp(m.lr) OVER (ORDER BY m.session_idx ROWS 19 PRECEDING) * sqrt(252) END AS mkt_vol20, m.dist52 AS mkt_dist52, nullif(g.ret20d, 0) - nullif(m.ret20d, 0) AS growth_rel20
      FROM (SELECT *, CASE WHEN lag(a, 20) OVER (ORDER BY session_idx) <> 0 THEN a / lag(a, 20) OVER (ORDER BY session_idx) - 1 END AS ret20d FROM own, bench WHERE entity = b) m
      LEFT JOIN (SELECT session_idx, CASE WHEN lag(a, 20) OVER (ORDER BY session_idx) <> 0 THEN a / lag(a, 20) OVER (ORDER BY session_idx) - 1 END AS ret20d FROM own, bench WHERE entity = g) g USING (session_idx)""",
    "macro": """SELECT session_idx, vix, CASE WHEN vix > 0 AND lag(vix, 5) OVER (w) > 0 THEN vix / lag(vix, 5) OVER (w) - 1 END AS vix_chg5, slope, fed - lag(fed, 63) OVER (w) AS d_rate90, bei - lag(bei, 20) OVER (w) AS bei_chg20,
      CASE WHEN lag(usd, 20) OVER (w) > 0 THEN usd / lag(usd, 20) OVER (w) - 1 END AS usd_chg20, CASE WHEN lag(oil, 20) OVER (w) > 0 THEN oil / lag(oil, 20) OVER (w) - 1 END AS oil_chg20, (hy - lag(hy, 20) OVER (w)) * 100 AS hy_chg20,
      CASE WHEN lag(btc, 5) OVER (w) > 0 THEN btc / lag(btc, 5) OVER (w) - 1 END AS btc_ret5, CASE WHEN lag(btc, 20) OVER (w) > 0 THEN btc / lag(btc, 20) OVER (w) - 1 END AS btc_ret20, fng / 100 AS fng FROM levels WINDOW w AS (ORDER BY session_idx)""",
    "event_rows": f"""SELECT entity, session_idx, dte, CAST(load AS INT) + CASE WHEN dte <= 7 THEN 1 ELSE 0 END AS event_load5, fomc AS is_fomc_day FROM (
      SELECT *, coalesce(least(45, date_diff('day', session_date, ahead)), 45) AS dte, coalesce(sum(fomc) OVER ({_BY} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS load FROM (
        SELECT x.entity, x.session_idx, x.session_date, CASE WHEN m.session_idx IS NULL THEN 0 ELSE 1 END AS fomc, min(CASE WHEN s.event_idx IS NOT NULL THEN x.session_date END) OVER (PARTITION BY x.entity ORDER BY x.session_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead
        FROM grid x LEFT JOIN (SELECT DISTINCT entity, event_idx FROM snapped) s ON s.entity = x.entity AND s.event_idx = x.session_idx LEFT JOIN market_events m ON m.session_idx = x.session_idx))""",
    "wide": "SELECT n.*, CASE WHEN dv_sd > 0 THEN (dv20 - dv_mean) / dv_sd END AS dv20z, CASE WHEN vol20 > 0 THEN vol5 / CAST(vol20 AS DOUBLE) END AS vol_ratio, CAST(ret20 AS DOUBLE) - mkt_ret20 AS rel_bench20, m.* EXCLUDE (session_idx), x.* EXCLUDE (session_idx), e.* EXCLUDE (entity, session_idx) FROM liquid n LEFT JOIN market m USING (session_idx) LEFT JOIN macro x USING (session_idx) LEFT JOIN event_rows e ON e.entity = n.entity AND e.session_idx = n.session_idx",
    "features": "SELECT entity, session_idx, session_date, o, h, l, c, a, v, " + ", ".join(f"CASE WHEN a IS NOT NULL THEN CAST({f} AS FLOAT) END AS {f}" for f in FEATURES) + ", session_idx >= 60 AND a IS NOT NULL AND ret20 IS NOT NULL AND vol20 IS NOT NULL AS valid FROM wide",
    "long": f"SELECT * FROM (UNPIVOT (SELECT entity, session_idx, {', '.join(FEATURES)} FROM features WHERE valid) ON {', '.join(FEATURES)} INTO NAME feature VALUE x)",
    "stats": """SELECT feature, session_idx, n, CASE WHEN n > 2 THEN s / n ELSE 0 END AS mu, CASE WHEN n > 2 AND q - s * s / n > 0 THEN sqrt(abs(q - s * s / n) / (n - 1)) ELSE 1 END AS sd FROM (
      SELECT f.feature, k.session_idx, coalesce(sum(d.s) OVER (w), 0) AS s, coalesce(sum(d.q) OVER (w), 0) AS q, CAST(coalesce(sum(d.n) OVER (w), 0) AS BIGINT) AS n
      FROM calendar k CROSS JOIN (SELECT unnest([""" + ", ".join(f"'{f}'" for f in FEATURES) + """]) AS feature) f
      LEFT JOIN (SELECT feature, session_idx, sum(CAST(x AS DOUBLE)) AS s, sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS q, count(*) AS n FROM long GROUP BY ALL) d ON d.feature = f.feature AND d.session_idx = k.session_idx
      WINDOW w AS (PARTITION BY f.feature ORDER BY k.session_idx))""",
    "z": "SELECT entity, session_idx, feature, CAST(greatest(-3, least(3, (CAST(x AS DOUBLE) - mu) / sd)) AS FLOAT) AS z FROM long JOIN stats USING (feature, session_idx)",
    "weights": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {w!r}::DOUBLE)" for f, w in sorted(distance_weights().items())) + ") t(feature, w)",
    "outcomes5": "SELECT entity, session_idx, CASE WHEN a > 0 AND lead(a, 5) OVER (w) > 0 THEN lead(a, 5) OVER (w) / a - 1 END AS y, CASE WHEN a > 0 AND c > 0 THEN min(l) OVER f / c - 1 END AS mae, CASE WHEN a > 0 AND c > 0 THEN max(h) OVER f / c - 1 END AS mfe FROM grid WINDOW w AS (PARTITION BY entity ORDER BY session_idx), f AS (PARTITION BY entity ORDER BY session_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)",
    "candles": "SELECT event_type AS instrument, date_trunc('hour', ts) AS ts, last(value ORDER BY ts, event_id) AS c, max(value) AS hi, min(value) AS lo, sum(value) AS qv FROM events WHERE value > 0 GROUP BY 1, 2",
    "moves": "SELECT instrument, ts, c / old - 1 AS ret, isodow(ts) < 6 AND hour(ts) BETWEEN 13 AND 20 AS open, qv > 0 AS traded FROM (SELECT *, lag(c) OVER (PARTITION BY instrument ORDER BY ts) AS old FROM candles) WHERE old > 0 AND c > 0",
    "blocks": """SELECT instrument, start_ts, end_ts, hours, CASE WHEN hours >= 48 THEN 'weekend' ELSE 'overnight' END AS kind, entry, exit, (exit / entry - 1) * 100 AS return_pct, (low / entry - 1) * 100 AS mae_pct, (high / entry - 1) * 100 AS mfe_pct FROM (
      SELECT instrument, run, count(*) AS hours, min(ts) AS start_ts, max(ts) AS end_ts, first(before ORDER BY ts) AS entry, last(c ORDER BY ts) AS exit, min(lo) AS low, max(hi) AS high FROM (
        SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY instrument ORDER BY ts) AS run FROM (
          SELECT *, coalesce(ts = lag(ts) OVER (w) + INTERVAL 1 HOUR, false) AND NOT (isodow(ts) < 6 AND hour(ts) BETWEEN 13 AND 20) AS inside, lag(c) OVER (w) AS before FROM candles WINDOW w AS (PARTITION BY instrument ORDER BY ts)))
      WHERE inside GROUP BY instrument, run) WHERE hours >= 12""",
}


def with_layers(sql: str) -> str:
    """The query with the layers that it names, directly or through others, in front."""
    needed: dict[str, None] = {}

    def add(text: str) -> None:
        for name, body in LAYERS.items():
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                add(body)
                needed[name] = None

    add(sql)
    ctes = ", ".join(f"{name} AS MATERIALIZED ({LAYERS[name]})" for name in needed)
    if not ctes:
        return sql
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql.removeprefix('WITH RECURSIVE ')}"
    if sql.startswith("WITH "):
        return f"WITH {ctes}, {sql.removeprefix('WITH ')}"
    return f"WITH {ctes} {sql}"
