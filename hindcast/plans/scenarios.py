"""Queries that run the registry of scenarios as one retrieval, and reports on the chosen states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import closed, retrieval, stress, validation
from ..operators.stress import SCENARIOS, Scenario
from .queries import _ASKED, _FOUND, _GREEDY, _OUT, _POOL, HORIZON, K, asked, chosen, query
from .tables import Panel

#: The tables end in 1998: windows of the registry are looked for that many years earlier.
YEARS_BACK = 25
#: The state as it is comes first, then the scenarios; the one composed with a venue's blocks has a query of its own.
RUN = [Scenario("as-is", "base"), *(s for s in SCENARIOS if s.kind != "venue")]

_text = lambda d: f"CAST('{d}' AS DATE) - INTERVAL {YEARS_BACK} YEAR" if d else "NULL::DATE"
_number = lambda x: f"{x}::DOUBLE" if x is not None else "NULL::DOUBLE"
_SPANS = (
    "listed(query_id, scenario, d1, d2) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{s.id}', {_text(s.date_from)}, {_text(s.date_to)})" for i, s in enumerate(RUN)) + "), "
    "moved(query_id, feature, dz, raw) AS (VALUES " + ", ".join(f"({i}, '{f}', {_number(s.z.get(f))}, {_number(s.raw.get(f))})" for i, s in enumerate(RUN) for f in {**s.z, **s.raw}) + """),
dated AS (SELECT l.query_id, scenario, min(session_idx) FILTER (WHERE session_date >= d1) AS j1, max(session_idx) FILTER (WHERE session_date <= d2) AS j2, min(session_idx) FILTER (WHERE session_date >= d2) AS j3 FROM listed l CROSS JOIN calendar GROUP BY ALL),
spans AS MATERIALIZED (SELECT query_id, scenario, coalesce(j3 > q - 5, false) AS skipped, greatest(60, coalesce(j1, 60)) AS j_low, least(q - 5, coalesce(j2, q - 5)) AS j_high FROM dated, asked)"""
)
_SHOCKED = """state AS (SELECT s.feature, mu, sd, CAST(qz AS DOUBLE) AS z0 FROM stats s JOIN asked ON s.session_idx = q LEFT JOIN qz USING (feature)),
replaced AS (SELECT l.query_id, s.feature, dz, CASE WHEN raw IS NOT NULL THEN greatest(-3, least(3, (raw - mu) / sd)) ELSE z0 END AS z1 FROM listed l CROSS JOIN state s LEFT JOIN moved m ON m.query_id = l.query_id AND m.feature = s.feature),
shocked AS MATERIALIZED (SELECT query_id, feature, CASE WHEN dz IS NOT NULL THEN greatest(-3, least(3, coalesce(z1, 0) + dz)) ELSE z1 END AS qz FROM replaced WHERE dz IS NOT NULL OR z1 IS NOT NULL)"""


def pools(queries: str, bounds: str, digits: str = "dist") -> str:
    """SQL of the chosen states (query_id, entity, session_idx) of many queries (query_id, feature, qz) with bounds (query_id, j_low, j_high)."""
    return f"""met AS MATERIALIZED (SELECT s.query_id, x.entity, x.session_idx, sqrt(sum(w * power(CAST(s.qz AS DOUBLE) - CAST(x.z AS DOUBLE), 2)) / sum(w)) AS dist FROM z x JOIN {queries} s USING (feature) JOIN weights USING (feature) JOIN {bounds} b ON b.query_id = s.query_id WHERE x.session_idx BETWEEN j_low AND j_high GROUP BY ALL HAVING sum(w) >= 0.6),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {digits}, entity, session_idx) AS rn FROM met QUALIFY rn <= 2000),
fold AS (SELECT query_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(e VARCHAR, j INT)[]) AS kept FROM {bounds} UNION ALL
SELECT p.query_id, p.rn, CASE WHEN len(list_filter(kept, lambda x: x.j = p.session_idx)) < 2 AND len(list_filter(kept, lambda x: x.e = p.entity AND abs(x.j - p.session_idx) < 10)) = 0 THEN list_append(kept, {{'e': p.entity, 'j': p.session_idx}}) ELSE kept END
FROM fold g JOIN ranked p ON p.query_id = g.query_id AND p.rn = g.rn + 1 WHERE len(kept) < 20), states AS MATERIALIZED (SELECT query_id, x.e AS entity, x.j AS session_idx FROM (SELECT query_id, unnest(kept) AS x FROM (SELECT query_id, arg_max(kept, rn) AS kept FROM fold GROUP BY query_id)))"""


_FIGURES = "count(y) AS n, round(quantile_cont(y, 0.1), 4) AS p10, round(quantile_cont(y, 0.5), 4) AS median, round(quantile_cont(y, 0.9), 4) AS p90, round(avg(CASE WHEN y > 0 THEN 1.0 WHEN y <= 0 THEN 0 END), 4) AS p_up, round(quantile_cont(mae, 0.5), 4) AS mae_median"
_REPORT = f"""WITH RECURSIVE {_ASKED}, {_SPANS}, {_SHOCKED}, {pools("shocked", "(SELECT * FROM spans WHERE NOT skipped)", "round(dist, 7)")},
figures AS (SELECT s.query_id, scenario, skipped, n, p10, median, p90, p_up, mae_median FROM spans s LEFT JOIN (SELECT query_id, {_FIGURES} FROM states JOIN outcomes5 USING (entity, session_idx) GROUP BY query_id) USING (query_id)),
report AS (SELECT f.scenario, f.skipped, coalesce(f.n, 0) AS n, f.p10, f.median, f.p90, f.p_up, f.mae_median, round(f.p10 - b.p10, 4) + 0 AS d_p10, round(f.median - b.median, 4) + 0 AS d_median, round(f.mae_median - b.mae_median, 4) + 0 AS d_mae_median FROM figures f, figures b WHERE b.query_id = 0)"""


def report(p: Panel) -> DataFrame:
    return p.once("scenario-report", _report)


def _report(p: Panel) -> DataFrame:
    z, q = asked(p)
    spans = stress.scenario_spans(p.calendar, q, HORIZON, RUN, YEARS_BACK)
    queries = stress.scenario_queries(z.select("feature", "z"), p.stats.filter(F.col("session_idx") == q).select("feature", "mu", "sd"), spans, RUN)
    found = retrieval.distances(p.vectors, retrieval.query_vectors(queries)).withColumn("dist", F.round("dist", 7))
    states = retrieval.greedy(retrieval.pool(found, K), K).join(retrieval.outcomes(p.grid, HORIZON), ["entity", "session_idx"])
    return stress.scenario_report(spans, states.select("query_id", "fwd_5", "mae"), "fwd_5")


@query(f"{_REPORT} SELECT * FROM report", 4)
def scenario_deltas(p: Panel) -> DataFrame:
    """Windows and shocks of the registry: what followed the states nearest to each, against the state as it is."""
    return report(p)


@query(f"""{_REPORT}, placed AS (SELECT scenario, median, row_number() OVER (ORDER BY median, scenario) AS worst, row_number() OVER (ORDER BY median DESC, scenario) AS best FROM report WHERE median IS NOT NULL AND scenario <> 'as-is')
SELECT scenario, median, CASE WHEN worst <= 3 THEN 'worst' ELSE 'best' END AS kind FROM placed WHERE worst <= 3 OR best <= 2""", 4)
def scenario_extremes(p: Panel) -> DataFrame:
    """The three worst and two best scenarios by median."""
    rows = report(p).filter("median is not null and scenario != 'as-is'")  # one row a scenario of the registry
    by = lambda c: F.row_number().over(Window.orderBy(c, "scenario"))
    placed = rows.withColumns({"worst": by(F.col("median")), "best": by(F.col("median").desc())}).filter("worst <= 3 or best <= 2")
    return placed.select("scenario", "median", F.when(F.col("worst") <= 3, "worst").otherwise("best").alias("kind"))


@query(f"""WITH RECURSIVE {_ASKED}, {_FOUND}, {_POOL}, {_GREEDY}, {_OUT}, venue AS (SELECT min(instrument) AS v FROM blocks WHERE kind = 'overnight'),
numbered AS (SELECT row_number() OVER (ORDER BY start_ts) - 1 AS block_no, return_pct, mae_pct, mfe_pct, count(*) OVER () AS size FROM blocks, venue WHERE instrument = v AND kind = 'overnight'),
turned AS (SELECT entity, session_idx, row_number() OVER (ORDER BY rn) - 1 AS turn FROM chosen JOIN pool USING (entity, session_idx))
SELECT CAST(0 AS BIGINT) AS query_id, t.entity, t.session_idx, CAST(block_no AS INT) AS block_no, round((1 + return_pct / 100) * (1 + fwd_5) - 1, 5) AS fwd, round(least(mae_pct / 100, (1 + return_pct / 100) * (1 + mae) - 1), 5) AS mae,
round(greatest(coalesce(mfe_pct, 0) / 100, (1 + return_pct / 100) * (1 + coalesce(mfe, 0)) - 1), 5) AS mfe FROM turned t JOIN outcome USING (entity, session_idx) JOIN numbered ON block_no = turn % size WHERE fwd_5 IS NOT NULL AND mae IS NOT NULL AND return_pct IS NOT NULL AND mae_pct IS NOT NULL""", 5)
def composed_blocks(p: Panel) -> DataFrame:
    """The chosen states' paths after the measured overnight blocks of the first instrument, taken in turn."""
    own = closed.closed_blocks(p.hourly).filter("kind = 'overnight'")
    own = own.join(F.broadcast(own.agg(F.min("instrument").alias("instrument"))), "instrument")
    blocks = own.select((F.row_number().over(Window.orderBy("start_ts")) - 1).alias("block_no"), "return_pct", "mae_pct", "mfe_pct")
    states = chosen(p).join(retrieval.outcomes(p.grid, HORIZON), ["entity", "session_idx"])
    return stress.compose_blocks(states, blocks, "fwd_5")


@query(f"WITH {_ASKED} SELECT feature, round(CAST(qz AS DOUBLE), 3) AS z FROM qz ORDER BY abs(round(CAST(qz AS DOUBLE), 3)) DESC, feature LIMIT 8", 3)
def notable_features(p: Panel) -> DataFrame:
    """The eight features of the asked state that lie farthest from usual."""
    rows = asked(p)[0].select("feature", F.round(F.col("z").cast("double"), 3).alias("z"))
    return rows.orderBy(F.abs("z").desc(), "feature").limit(8)


@query(f"""WITH RECURSIVE {_ASKED}, {_FOUND}, {_POOL}, {_GREEDY}, {_OUT} SELECT CAST(l AS INT) AS tolerance, count(mae) AS n, round(100 * avg(CASE WHEN mae <= -l / 100 THEN 1.0 WHEN mae > -l / 100 THEN 0 END), 6) AS breached_pct FROM chosen JOIN outcome USING (entity, session_idx), range(1, 51) t(l) GROUP BY l""")
def stated_tolerance(p: Panel) -> DataFrame:
    """Share of chosen states whose worst excursion breached each stated tolerance from 1 to 50 percent."""
    states = chosen(p).join(retrieval.outcomes(p.grid, HORIZON), ["entity", "session_idx"]).select("mae", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("tolerance"))
    return states.groupBy("tolerance").agg(F.count("mae").alias("n"), (100 * F.avg((F.col("mae") <= -F.col("tolerance") / 100).cast("int"))).alias("breached_pct"))


_SWEEP = f"""WITH RECURSIVE times AS (SELECT session_idx FROM (SELECT session_idx, row_number() OVER (ORDER BY session_idx) - 1 AS n FROM calendar WHERE session_date >= DATE '1999-01-01') WHERE n % 25 = 0 AND session_idx >= 60 AND session_idx + 5 <= (SELECT max(session_idx) FROM calendar)),
asking AS MATERIALIZED (SELECT row_number() OVER (ORDER BY f.entity, f.session_idx) AS query_id, f.entity, f.session_idx AS q, 60 AS j_low, f.session_idx - 5 AS j_high FROM times JOIN features f USING (session_idx) WHERE valid),
askz AS MATERIALIZED (SELECT query_id, feature, CAST(x.z AS DOUBLE) AS qz FROM asking s JOIN z x ON x.entity = s.entity AND x.session_idx = s.q), {pools("askz", "asking")}"""


@query(f"{_SWEEP} SELECT a.entity, CAST(a.q AS INT) AS q, count(*) AS n, round(min(m.dist), 5) AS nearest, max(s.session_idx) AS last_idx FROM states s JOIN asking a USING (query_id) JOIN met m ON m.query_id = s.query_id AND m.entity = s.entity AND m.session_idx = s.session_idx GROUP BY a.entity, a.q", 5)
def batched_retrieval(p: Panel) -> DataFrame:
    """The validation sweep's retrieval: every 25th session of the test era on all entities, in one job."""
    grid = validation.query_grid(p.features, p.calendar, "1999-01-01", None, 25, HORIZON)
    vectors = p.vectors
    asking = grid.withColumn("query_id", F.xxhash64("entity", "session_idx"))
    queries = asking.join(vectors, ["entity", "session_idx"]).select("query_id", "z", F.lit(60).alias("j_low"), (F.col("session_idx") - HORIZON).alias("j_high"))
    picked = retrieval.greedy(retrieval.batched_pool(vectors, queries, K), K)
    best = picked.groupBy("query_id").agg(F.count("*").alias("n"), F.min("dist").alias("nearest"), F.max("session_idx").alias("last_idx"))
    return asking.join(best, "query_id").select("entity", F.col("session_idx").alias("q"), "n", "nearest", "last_idx")
