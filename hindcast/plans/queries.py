"""Queries over the driver's tables, one for each operator, with DuckDB oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import closed, distribution, panel, retrieval, sentiment, standardise, stress, validation
from ..schema import EXCLUDED, FEATURES, GROUPS
from .layers import with_layers
from .tables import Panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    """Register a function of a Panel as a query; doubles are rounded, and dates written, alike in it and in its oracle."""

    def register(function: Callable[[Panel], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = function(Panel.of(spark, sf_dir))
            plain = {"double": lambda c: F.round(c, digits), "float": lambda c: F.round(c.cast("double"), digits), "date": lambda c: c.cast("string"), "timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}
            return df.select(*(plain.get(kind, lambda c: c)(F.col(c)).alias(c) for c, kind in df.dtypes))

        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = with_layers(sql)
        return function

    return register


def r(*columns: str, digits: int = 6) -> str:
    """SQL list of columns rounded as the query rounds them."""
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0 AS {c}" for c in columns)  # + 0: no negative zero


def by_features(names: list[str]) -> str:
    return f"SELECT entity, session_idx, {r(*names)} FROM features WHERE a IS NOT NULL"


# --- calendar, bars, joins ----------------------------------------------------------------------


@query(f"SELECT entity, CAST(session_date AS VARCHAR) AS session_date, {r('o', 'h', 'l', 'c', 'a', 'v')} FROM bars")
def bars_weekly(p: Panel) -> DataFrame:
    return p.bars


@query("SELECT entity, session_idx, CAST(session_date AS VARCHAR) AS session_date, round(a, 6) AS a FROM grid")
def calendar_align(p: Panel) -> DataFrame:
    return p.grid.select("entity", "session_idx", "session_date", "a")


@query("SELECT entity, count(*) AS n_dropped FROM bars WHERE session_date NOT IN (SELECT session_date FROM calendar) GROUP BY entity")
def dropped_rows(p: Panel) -> DataFrame:
    return panel.off_calendar(p.bars, p.calendar)


@query("SELECT series_id, session_idx, round(value, 6) AS value FROM carried")
def asof_ffill(p: Panel) -> DataFrame:
    return panel.asof(p.calendar, p.series)


@query("SELECT entity, CAST(event_date AS VARCHAR) AS event_date, event_idx FROM snapped")
def next_session_snap(p: Panel) -> DataFrame:
    return panel.next_session(p.calendar, p.entity_events).select("entity", "event_date", "event_idx")


@query("SELECT entity, session_idx, CAST(dte AS INT) AS dte, CAST(event_load5 AS INT) AS event_load5, is_fomc_day FROM event_rows")
def event_features(p: Panel) -> DataFrame:
    from ..operators.features import event_features as made

    market = p.market_events.join(p.calendar, F.col("event_date") == F.col("session_date")).select("session_idx")
    return made(p.grid, panel.next_session(p.calendar, p.entity_events), market)


@query("SELECT b.entity, count(*) AS n_rows, CAST(min(session_date) AS VARCHAR) AS first_date, CAST(max(session_date) AS VARCHAR) AS last_date, any_value(n) AS n_events FROM bars b JOIN (SELECT entity, count(*) AS n FROM entity_events GROUP BY entity) e ON e.entity = b.entity GROUP BY b.entity")
def coverage_report(p: Panel) -> DataFrame:
    return panel.coverage_report(p.bars, p.entity_events)


@query("""WITH x AS (SELECT DISTINCT entity, event_date AS d FROM entity_events), y AS (SELECT DISTINCT 'Brand#' || CAST(11 + o_custkey % 25 // 5 * 10 + o_custkey % 5 AS VARCHAR) AS entity, CAST(o_orderdate AS DATE) AS d FROM orders),
m AS (SELECT x.entity, x.d, y.d AS nearest, abs(date_diff('day', x.d, y.d)) AS days FROM x LEFT JOIN y ON y.entity = x.entity)
SELECT entity, CAST(d AS VARCHAR) AS d, CAST(arg_min(nearest, (days, nearest)) AS VARCHAR) AS nearest, min(days) AS days FROM m GROUP BY entity, d""")
def nearest_date_join(p: Panel) -> DataFrame:
    """All entities with all order dates: customers stand for the 25 brands in turn."""
    k = F.col("o_custkey") % 25
    brand = 11 + F.floor(k / 5) * 10 + k % 5
    right = p.table("orders").select(F.concat(F.lit("Brand#"), brand.cast("string")).alias("entity"), F.col("o_orderdate").cast("date").alias("d"))
    return panel.nearest_date(p.entity_events.select("entity", F.col("event_date").alias("d")), right)



@query("""WITH RECURSIVE d AS (SELECT entity, session_date AS d, row_number() OVER (PARTITION BY entity ORDER BY session_date) AS rn FROM bars),
k AS (SELECT entity, d, rn, d AS kept FROM d WHERE rn = 1 UNION ALL SELECT d.entity, d.d, d.rn, CASE WHEN date_diff('day', k.kept, d.d) > 20 THEN d.d ELSE k.kept END FROM k JOIN d ON d.entity = k.entity AND d.rn = k.rn + 1)
SELECT entity, CAST(d AS VARCHAR) AS d FROM k WHERE d = kept""")
def date_cluster(p: Panel) -> DataFrame:
    return panel.date_clusters(p.bars.select("entity", F.col("session_date").alias("d")), 20)


@query("""WITH s AS (SELECT DISTINCT upper(replace(n_name, ' ', '')) AS symbol FROM nation), b AS (SELECT DISTINCT upper(replace(n_name, ' ', '')) || suffix AS base FROM nation, (VALUES (''), ('X'), ('ON'), ('BSTX'), ('S')) t(suffix))
SELECT symbol, base, base || '_USDT' AS pair, CASE WHEN base = symbol THEN '(none)' ELSE substr(base, length(symbol) + 1) END AS suffix FROM s, b WHERE starts_with(base, symbol) AND length(base) <= length(symbol) + 3""")
def prefix_candidates(p: Panel) -> DataFrame:
    name = F.replace(F.col("n_name"), F.lit(" "), F.lit(""))
    nation = p.table("nation").select(name.alias("symbol"))
    pairs = nation.withColumn("x", F.explode(F.array(*map(F.lit, ("", "X", "ON", "BSTX", "S"))))).select(F.concat("symbol", "x").alias("base"), F.lit("USDT").alias("quote"))
    return panel.prefix_candidates(nation, pairs, "USDT")


@query("WITH x AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS v FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), y AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS v FROM orders GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (WHERE x.v = y.v) AS n_exact, round(avg(abs(x.v - y.v)), 4) AS mean_diff, round(max(abs(x.v - y.v)), 4) AS max_diff FROM x JOIN y USING (d)", digits=4)
def series_crosscheck(p: Panel) -> DataFrame:
    o = p.table("orders").select(F.col("o_orderdate").cast("date").alias("d"), "o_totalprice", "o_orderpriority")
    x = o.filter("o_orderpriority = '1-URGENT'").groupBy("d").agg(F.avg("o_totalprice").alias("x"))
    met = x.join(o.groupBy("d").agg(F.avg("o_totalprice").alias("y")), "d")
    gap = F.abs(F.col("x") - F.col("y"))
    return met.agg(F.count("*").alias("n"), F.sum((F.col("x") == F.col("y")).cast("long")).alias("n_exact"), F.avg(gap).alias("mean_diff"), F.max(gap).alias("max_diff"))


@query("WITH m AS (SELECT event_type AS symbol, user_id AS pair, sum(value) AS volume FROM events GROUP BY ALL) SELECT symbol, pair, round(volume, 6) AS volume, rn = 1 AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, pair) AS rn FROM m)")
def canonical_pick(p: Panel) -> DataFrame:
    m = p.table("events").groupBy(F.col("event_type").alias("symbol"), F.col("user_id").alias("pair")).agg(F.sum("value").alias("volume"))
    w = Window.partitionBy("symbol").orderBy(F.desc("volume"), "pair")
    return m.select("symbol", "pair", "volume", (F.row_number().over(w) == 1).alias("canonical"))


# --- features -----------------------------------------------------------------------------------


def feature_query(name: str, columns: list[str]) -> None:
    def made(p: Panel) -> DataFrame:
        return p.features.filter("a is not null").select("entity", "session_idx", *columns)

    made.__name__ = name
    query(by_features(columns), 5)(made)


for _name, _columns in {
    "ret_k": ["ret5", "ret20", "ret60"],
    "dist52": ["dist52"],
    "vol20": ["vol20"],
    "vol_ratio": ["vol_ratio"],
    "dd60": ["dd60"],
    "rel_bench": ["rel_bench20"],
    "gap20": ["gap20"],
    "dv20z": ["dv20z"],
    "market_features": ["mkt_ret20", "mkt_vol20", "mkt_dist52", "growth_rel20"],
    "macro_changes": ["vix_chg5", "usd_chg20", "oil_chg20", "btc_ret5", "btc_ret20"],
    "macro_levels": ["vix", "slope", "d_rate90", "bei_chg20", "hy_chg20", "fng"],
    "event_columns": ["dte", "event_load5", "is_fomc_day"],
}.items():
    feature_query(_name, _columns)
for _name in list(ORACLES):
    if _name in ("ret_k", "dist52", "vol20", "vol_ratio", "dd60", "rel_bench", "gap20", "dv20z", "market_features", "macro_changes", "macro_levels", "event_columns"):
        ORACLES[_name] = ORACLES[_name].replace(" AS DOUBLE), 6)", " AS DOUBLE), 5)")


@query("SELECT entity, session_idx, valid FROM features")
def valid_mask(p: Panel) -> DataFrame:
    return p.features.select("entity", "session_idx", "valid")


# --- statistics, z, distance --------------------------------------------------------------------

@query(f"SELECT feature, session_idx, n, {r('mu', 'sd', digits=4)} FROM stats", 4)
def expanding_stats(p: Panel) -> DataFrame:
    return p.stats



@query("SELECT entity, session_idx, feature, round(CAST(z AS DOUBLE), 3) + 0 AS z FROM z", 3)
def zscore_clip(p: Panel) -> DataFrame:
    return p.z


_GROUPED = ", ".join(f"('{f}', '{g}', {w}::DOUBLE)" for g, (w, names) in GROUPS.items() for f in names if f not in EXCLUDED)


@query(f"WITH g(feature, grp, share) AS (VALUES {_GROUPED}), u AS (SELECT DISTINCT feature FROM long), e AS (SELECT g.*, share / count(*) OVER (PARTITION BY grp) AS w FROM g JOIN u USING (feature)) SELECT feature, round(w / sum(w) OVER (), 9) AS w FROM e", 9)
def distance_weights(p: Panel) -> DataFrame:
    """Weights of the features that the panel has: a group's share is spread over those, and all are scaled to 1."""
    from ..schema import distance_weights as spread

    seen = p.features.filter("valid").agg(*(F.count(f).alias(f) for f in FEATURES)).first().asDict()
    return retrieval.weights_table(p.spark, spread(exclude=(*EXCLUDED, *(f for f, n in seen.items() if not n and f not in EXCLUDED))))


HORIZON, K = 5, 20
#: The query: the benchmark's last valid session.
_ASKED = "asked AS (SELECT entity, max(session_idx) AS q FROM features, bench WHERE valid AND entity = b GROUP BY entity), qz AS (SELECT feature, z AS qz FROM z, asked WHERE z.entity = asked.entity AND session_idx = q)"
_FOUND = "found AS (SELECT z.entity, z.session_idx, sqrt(sum(w * power(CAST(qz AS DOUBLE) - CAST(z AS DOUBLE), 2)) / sum(w)) AS dist FROM z JOIN qz USING (feature) JOIN weights USING (feature), asked WHERE session_idx BETWEEN 60 AND q - 5 GROUP BY z.entity, z.session_idx HAVING sum(w) >= 0.6)"
_POOL = "pool AS (SELECT *, row_number() OVER (ORDER BY round(dist, 7), entity, session_idx) AS rn FROM found QUALIFY rn <= 2000)"
_GREEDY = """g AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(e VARCHAR, j INT)[]) AS kept UNION ALL
SELECT p.rn, CASE WHEN len(kept) < 20 AND len(list_filter(kept, lambda x: x.j = p.session_idx)) < 2 AND len(list_filter(kept, lambda x: x.e = p.entity AND abs(x.j - p.session_idx) < 10)) = 0 THEN list_append(kept, {'e': p.entity, 'j': p.session_idx}) ELSE kept END
FROM g JOIN pool p ON p.rn = g.rn + 1 WHERE len(kept) < 20), picks AS (SELECT unnest(kept) AS x FROM (SELECT kept FROM g ORDER BY rn DESC LIMIT 1)), chosen AS (SELECT x.e AS entity, x.j AS session_idx FROM picks)"""
_AHEAD = "PARTITION BY entity ORDER BY session_idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING"
_OUT = f"outcome AS (SELECT entity, session_idx, CASE WHEN a > 0 AND lead(a, 5) OVER (w) > 0 THEN lead(a, 5) OVER (w) / a - 1 END AS fwd_5, CASE WHEN a > 0 AND c > 0 THEN min(l) OVER ({_AHEAD}) / c - 1 END AS mae, CASE WHEN a > 0 AND c > 0 THEN max(h) OVER ({_AHEAD}) / c - 1 END AS mfe FROM grid WINDOW w AS (PARTITION BY entity ORDER BY session_idx))"


def asked(p: Panel) -> tuple[DataFrame, int]:
    """(query_id, feature, z, j_low, j_high) of the benchmark's last valid session, and that session."""
    row = p.features.filter(F.col("valid") & (F.col("entity") == p.benchmark)).agg(F.max("session_idx").alias("q")).first()
    q = -1 if row.q is None else row.q
    z = p.z.filter((F.col("entity") == p.benchmark) & (F.col("session_idx") == q)).select("feature", "z")
    low, high = retrieval.bounds(p.calendar, F.lit(q), HORIZON)
    return z.select(F.lit(0).cast("long").alias("query_id"), "feature", "z", low.alias("j_low"), high.alias("j_high")), q


def found(p: Panel) -> DataFrame:
    """Distances to the query, rounded where the ranks of near ties could depend on the order of sums."""
    return p.once("found", lambda p: retrieval.distances(p.vectors, retrieval.query_vectors(asked(p)[0])).withColumn("dist", F.round("dist", 7)))


def chosen(p: Panel) -> DataFrame:
    return p.once("chosen", lambda p: retrieval.greedy(retrieval.pool(found(p), K), K))


@query(f"WITH {_ASKED}, {_FOUND} SELECT entity, session_idx, round(round(dist, 7), 4) AS dist FROM found", 4)
def knn_distance(p: Panel) -> DataFrame:
    return found(p).select("entity", "session_idx", "dist")


@query(f"WITH {_ASKED}, {_FOUND} SELECT entity, session_idx, round(round(dist, 7), 4) AS dist, rn FROM (SELECT *, row_number() OVER (ORDER BY round(dist, 7), entity, session_idx) AS rn FROM found QUALIFY rn <= 2000)", 4)
def knn_topk(p: Panel) -> DataFrame:
    return retrieval.pool(found(p), K).select("entity", "session_idx", "dist", "rn")


@query(f"WITH RECURSIVE {_ASKED}, {_FOUND}, {_POOL}, {_GREEDY} SELECT entity, session_idx FROM chosen")
def greedy_select(p: Panel) -> DataFrame:
    return chosen(p).select("entity", "session_idx")


@query("SELECT entity, session_idx, " + ", ".join(f"round(CASE WHEN a > 0 AND lead(a, {h}) OVER (w) > 0 THEN lead(a, {h}) OVER (w) / a - 1 END, 6) AS fwd_{h}" for h in (1, 5, 10, 20, 40, 60)) + " FROM grid WINDOW w AS (PARTITION BY entity ORDER BY session_idx)")
def forward_returns(p: Panel) -> DataFrame:
    return retrieval.outcomes(p.grid, HORIZON).drop("mae", "mfe")


@query(f"WITH {_OUT} SELECT entity, session_idx, {r('mae', 'mfe')} FROM outcome")
def mae_mfe(p: Panel) -> DataFrame:
    return retrieval.outcomes(p.grid, HORIZON).select("entity", "session_idx", "mae", "mfe")


@query(f"WITH RECURSIVE {_ASKED}, {_FOUND}, {_POOL}, {_GREEDY}, {_OUT} SELECT count(fwd_5) AS n, round(quantile_cont(fwd_5, 0.5), 5) AS median, round(quantile_cont(fwd_5, 0.1), 5) AS p10, round(quantile_cont(fwd_5, 0.9), 5) AS p90, round(avg(CASE WHEN fwd_5 > 0 THEN 1.0 WHEN fwd_5 <= 0 THEN 0 END), 5) AS p_up FROM chosen JOIN outcome USING (entity, session_idx)", 5)
def analog_outlook(p: Panel) -> DataFrame:
    """The flagship: what followed the nearest past states of one entity."""
    met = chosen(p).join(retrieval.outcomes(p.grid, HORIZON), ["entity", "session_idx"])
    q = F.percentile("fwd_5", F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9)))
    out = met.agg(F.count("fwd_5").alias("n"), q.alias("q"), F.avg((F.col("fwd_5") > 0).cast("int")).alias("p_up"))
    return out.select("n", F.col("q")[0].alias("median"), F.col("q")[1].alias("p10"), F.col("q")[2].alias("p90"), "p_up")


@query(f"WITH {_ASKED}, {_FOUND} SELECT (SELECT count(*) FROM features, asked WHERE valid AND session_idx BETWEEN 60 AND q - 5) AS scanned, (SELECT count(*) FROM found) AS eligible")
def scan_stats(p: Panel) -> DataFrame:
    _, q = asked(p)
    scanned = p.features.filter(F.col("valid") & F.col("session_idx").between(60, q - HORIZON)).agg(F.count("*").alias("scanned"))
    return scanned.crossJoin(found(p).agg(F.count("*").alias("eligible")))


@query("SELECT q.vec_id AS query_id, c.vec_id, rank FROM (SELECT q.vec_id AS qid, c.vec_id AS cid, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(range(1, 65), lambda i: power(q.embedding[i]::DOUBLE - c.embedding[i]::DOUBLE, 2))), c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id QUALIFY rank <= 5) x JOIN embeddings q ON q.vec_id = qid JOIN embeddings c ON c.vec_id = cid")
def embedding_knn(p: Panel) -> DataFrame:
    """Exact nearest vectors of a stated query set."""
    e = p.table("embeddings").select("vec_id", F.col("embedding").alias("v"))
    return retrieval.nearest_vectors(e, e.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 5)
