"""Queries that a result card is made of: the chosen states with their dimension and paths, groups, extremes and the scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import pathrisk, validation
from .predictors import _SCORES, predicted, states, sweep
from .queries import _ASKED, _FOUND, _GREEDY, _POOL, HORIZON, chosen, query
from .scores import _BY_SYMBOL, _RISK, by_symbol, risks
from .tables import Panel

_CHOSEN = f"WITH RECURSIVE {_ASKED}, {_FOUND}, {_POOL}, {_GREEDY}, listed AS (SELECT c.entity, c.session_idx, row_number() OVER (ORDER BY p.rn) AS place, count(*) OVER () AS n, p.dist FROM chosen c JOIN pool p ON p.entity = c.entity AND p.session_idx = c.session_idx)"


@query(f"{_CHOSEN}, named AS (SELECT p_brand AS entity, min(p_type) AS name FROM part GROUP BY p_brand HAVING count(*) > 3) SELECT l.entity, session_idx, coalesce(name, l.entity) AS name, substr(l.entity, 7, 1) AS sector, l.entity = b AS same_name, CAST(place AS INT) AS place, place <= 12 AS first_12, (place - 1) % CAST(ceil(n / 12) AS INT) = 0 AS thinned FROM listed l LEFT JOIN named USING (entity), bench")
def listed_states(p: Panel) -> DataFrame:
    """The chosen states with their dimension, whether they are the asked entity's own, and which of them a short list and a thinned fan show."""
    named = p.table("part").groupBy(F.col("p_brand").alias("entity")).agg(F.min("p_type").alias("name"), F.count("*").alias("n")).filter("n > 3").drop("n")
    own = chosen(p).select("entity", "session_idx", F.row_number().over(Window.orderBy("rn")).alias("place"), F.count("*").over(Window.partitionBy()).alias("n"))  # K rows
    met = own.join(named, "entity", "left")
    thinned = (F.col("place") - 1) % F.ceil(F.col("n") / 12) == 0
    return met.select("entity", "session_idx", F.coalesce("name", "entity").alias("name"), F.substring("entity", 7, 1).alias("sector"), (F.col("entity") == p.benchmark).alias("same_name"), "place", (F.col("place") <= 12).alias("first_12"), thinned.alias("thinned"))


@query(f"{_CHOSEN} SELECT l.entity, l.session_idx, CAST(t AS INT) AS t, round(f.a / g.a - 1, 6) + 0 AS ret FROM listed l JOIN grid g ON g.entity = l.entity AND g.session_idx = l.session_idx, range(1, {HORIZON + 1}) s(t) JOIN grid f ON f.entity = l.entity AND f.session_idx = l.session_idx + t WHERE g.a > 0 AND f.a IS NOT NULL")
def chosen_paths(p: Panel) -> DataFrame:
    """The adjusted path after each chosen state, step by step."""
    steps = chosen(p).select("entity", "session_idx", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))).alias("t")).withColumn("at", F.col("session_idx") + F.col("t"))
    close = p.grid.select("entity", F.col("session_idx").alias("at"), "a")
    entry = close.filter("a > 0").select("entity", F.col("at").alias("session_idx"), F.col("a").alias("a0"))
    met = steps.join(entry, ["entity", "session_idx"]).join(close.filter("a is not null"), ["entity", "at"])
    return met.select("entity", "session_idx", "t", (F.col("a") / F.col("a0") - 1).alias("ret"))


@query(f"""{_CHOSEN}, e AS (SELECT 'sector' AS kind, substr(entity, 7, 1) AS value FROM listed UNION ALL SELECT 'year', CAST(year(session_date) AS VARCHAR) FROM listed JOIN calendar USING (session_idx)),
c AS (SELECT kind, value, count(*) AS n FROM e GROUP BY ALL) SELECT kind, value, n, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS INT) AS place FROM c QUALIFY place <= CASE kind WHEN 'sector' THEN 1 ELSE 3 END""")
def top_groups(p: Panel) -> DataFrame:
    """The sector and the three years with the most chosen states."""
    rows = chosen(p).join(p.calendar.select("session_idx", "session_date"), "session_idx")
    each = rows.select(F.explode(F.create_map(F.lit("sector"), F.substring("entity", 7, 1), F.lit("year"), F.year("session_date").cast("string"))).alias("kind", "value"))
    counted = each.groupBy("kind", "value").agg(F.count("*").alias("n"))
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value")))
    return placed.filter(F.col("place") <= F.when(F.col("kind") == "sector", 1).otherwise(3))


@query(f"{_BY_SYMBOL}, p AS (SELECT entity, round(coverage, 6) AS coverage, row_number() OVER (ORDER BY round(coverage, 6) DESC, entity) AS best, row_number() OVER (ORDER BY round(coverage, 6), entity DESC) AS worst FROM symbols WHERE predictor = 'analog_conformal') SELECT entity, coverage, CASE WHEN best <= 5 THEN 'best' ELSE 'worst' END AS kind FROM p WHERE best <= 5 OR worst <= 5")
def best_worst_symbols(p: Panel) -> DataFrame:
    """The five entities that the analogs' band covers best, and the five worst."""
    rows = by_symbol(p).filter("predictor = 'analog_conformal'").select("entity", F.round("coverage", 6).alias("coverage"))
    best, worst = rows.orderBy(F.desc("coverage"), "entity").limit(5), rows.orderBy("coverage", F.desc("entity")).limit(5)
    return best.withColumn("kind", F.lit("best")).unionByName(worst.join(best.select("entity"), "entity", "left_anti").withColumn("kind", F.lit("worst")))


@query(f"{_SCORES}, m AS (SELECT w.entity, w.q, list_sort(list(d.dist)) AS s FROM states s JOIN met d ON d.query_id = s.query_id AND d.entity = s.entity AND d.session_idx = s.session_idx JOIN sweep w ON w.query_id = s.query_id GROUP BY ALL) SELECT entity, CAST(q AS INT) AS q, CAST(len(s) AS INT) AS n, round(s[len(s) // 2 + 1], 5) AS median_distance FROM m", 5)
def median_distances(p: Panel) -> DataFrame:
    """For each query of the sweep the distance in the middle of its chosen states', not interpolated."""
    held = states(p).groupBy("query_id").agg(F.collect_list("dist").alias("d"))  # the chosen of a query
    out = held.select("query_id", F.size("d").alias("n"), scalar.upper_median(F.col("d")).alias("median_distance"))
    return sweep(p).join(out, "query_id").select("entity", "q", "n", "median_distance")


@query(f"""{_RISK}, usable AS (SELECT *, abs(y - centre) / half AS off FROM predicted WHERE half > 0),
lists AS (SELECT predictor, list_sort(list(off)) AS s, (count(*) - 1) * least(1, ceil((count(*) + 1) * CAST(0.8 AS DOUBLE)) / count(*)) AS place FROM usable WHERE era = 'calibration' GROUP BY predictor),
scales AS (SELECT predictor, CASE WHEN predictor IN ('analog_raw', 'own_past') THEN 1 ELSE s[CAST(floor(place) AS INT) + 1] + (s[CAST(ceil(place) AS INT) + 1] - s[CAST(floor(place) AS INT) + 1]) * (place - floor(place)) END AS scale FROM lists),
bands1 AS (SELECT predictor, count(*) AS n, avg(CASE WHEN off <= scale THEN 1 ELSE 0 END) AS coverage, avg(2 * half * scale) AS width FROM usable JOIN scales USING (predictor) WHERE era = 'test' GROUP BY predictor)
SELECT 'band' AS kind, predictor, n, round(coverage, 5) AS first, round(width, 5) AS second FROM bands1 UNION ALL SELECT 'path risk', predictor, count(*), round(avg(power(p - y, 2)), 5), round(avg(p), 5) FROM longs WHERE level = 0.1 GROUP BY predictor""", 5)
def validation_summary(p: Panel) -> DataFrame:
    """The scorecard: coverage and width of every predictor's band, and Brier score and mean of every path-risk predictor at the 10 % level."""
    bands = validation.frozen_scores(predicted(p)).select(F.lit("band").alias("kind"), "predictor", "n", F.col("coverage").alias("first"), F.col("width").alias("second"))
    risk = pathrisk.by_predictor(risks(p).filter("level = 0.1")).groupBy("predictor").agg(F.count("*").alias("n"), F.avg((F.col("p") - F.col("y")) ** 2).alias("first"), F.avg("p").alias("second"))
    return bands.unionByName(risk.select(F.lit("path risk").alias("kind"), "predictor", "n", "first", "second"))
