"""Queries that measure one venue against another: tracking, refusals, books, summaries, and the views of each symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import closed, panel, sentiment, validation
from .queries import query, r
from .tables import Panel

#: Least changes in common, and how far (percent) the last prices may differ: wider than for one security's two listings, as the tables' venues share none.
LEAST_OVERLAP, PERCENT = 10, 60.0
_DAILY = "daily AS MATERIALIZED (SELECT event_type || ':' || CAST(user_id // 2 % 7 AS VARCHAR) AS symbol, CAST(ts AS DATE) AS d, avg(value) FILTER (WHERE user_id % 2 <> 0) AS x, avg(value) FILTER (WHERE user_id % 2 = 0) AS y FROM events WHERE value > 0 GROUP BY ALL)"
_TRACKED = f"""{_DAILY}, met AS (SELECT symbol, x / y - 1 AS premium, x / lag(x) OVER w - 1 AS rx, y / lag(y) OVER w - 1 AS ry FROM daily WHERE x > 0 AND y > 0 WINDOW w AS (PARTITION BY symbol ORDER BY d)),
tracked AS MATERIALIZED (SELECT symbol, count(rx) AS n, CASE WHEN count(rx) >= 3 AND stddev_pop(rx) * stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS correlation, stddev_samp(rx - ry) * 10000 AS error_bp, quantile_cont(premium, 0.1) AS p10, quantile_cont(premium, 0.5) AS p50, quantile_cont(premium, 0.9) AS p90 FROM met GROUP BY symbol),
lasts AS (SELECT symbol, arg_max(x, d) FILTER (WHERE x IS NOT NULL) AS live, arg_max(y, d) FILTER (WHERE y IS NOT NULL) AS ref FROM daily GROUP BY symbol),
stages AS MATERIALIZED (SELECT symbol, coalesce(n, 0) AS n, correlation, error_bp, p10, p50, p90, live, ref, CASE WHEN live IS NULL THEN 'listing' WHEN ref IS NULL THEN 'library' WHEN abs(live / ref - 1) * 100 > {PERCENT} THEN 'price' WHEN coalesce(n, 0) < {LEAST_OVERLAP} THEN 'overlap' WHEN coalesce(correlation < 0.0, true) THEN 'correlation' END AS stage,
CASE WHEN correlation >= 0.95 AND error_bp <= 60 THEN 'tight' WHEN correlation >= 0.85 THEN 'fair' WHEN correlation >= 0.5 THEN 'loose' ELSE 'rejected' END AS tier FROM lasts LEFT JOIN tracked USING (symbol))"""


def _daily(p: Panel) -> DataFrame:
    """(symbol, d, x, y): each symbol's mean price by day on the measured venue (odd users) and on the reference (even users)."""
    symbol = F.concat("event_type", F.lit(":"), (F.floor(F.col("user_id") / 2) % 7).cast("string"))
    own = p.table("events").filter("value > 0").select(symbol.alias("symbol"), F.to_date("ts").alias("d"), "value", (F.col("user_id") % 2 == 0).alias("ref"))
    return own.groupBy("symbol", "d").agg(F.avg(F.when(~F.col("ref"), F.col("value"))).alias("x"), F.avg(F.when(F.col("ref"), F.col("value"))).alias("y"))


def daily(p: Panel) -> DataFrame:
    return p.once("venue-daily", _daily)


def _staged(p: Panel) -> DataFrame:
    """Each symbol's measurement, and the first stage that refuses it, null if none does."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("d")))
    lasts = daily(p).groupBy("symbol").agg(last("x").alias("live"), last("y").alias("ref"))
    met = lasts.join(closed.tracking(daily(p)), "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    stage = F.when(F.col("live").isNull(), "listing").when(F.col("ref").isNull(), "library").when(~scalar.price_ratio_ok(F.col("live"), F.col("ref"), PERCENT), "price")
    stage = stage.when(F.col("n") < LEAST_OVERLAP, "overlap").when(F.coalesce(F.col("correlation") < 0, F.lit(True)), "correlation")
    return met.withColumns({"stage": stage, "tier": scalar.tracking_tier(F.col("correlation"), F.col("error_bp"))})


def stages(p: Panel) -> DataFrame:
    return p.once("venue-stages", _staged)


@query(f"WITH {_TRACKED} SELECT symbol, n, round(correlation, 6) + 0 AS correlation, round(error_bp, 4) AS error_bp, {r('p10', 'p50', 'p90')} FROM tracked")
def venue_tracking(p: Panel) -> DataFrame:
    """Correlation, tracking error and premium of each symbol between two venues."""
    return closed.tracking(daily(p)).withColumn("error_bp", F.round("error_bp", 4))


@query(f"WITH {_TRACKED} SELECT symbol, stage, CASE stage WHEN 'price' THEN 'last differs by ' || CAST(CAST(round(abs(live / ref - 1) * 100) AS BIGINT) AS VARCHAR) || ' percent' WHEN 'overlap' THEN CAST(n AS VARCHAR) || ' changes in common' WHEN 'correlation' THEN 'changes do not go together' ELSE 'no price' END AS reason FROM stages WHERE stage IS NOT NULL")
def venue_refusals(p: Panel) -> DataFrame:
    """Symbols that a stage of the measurement refuses, with the reason."""
    off = F.round(F.abs(F.col("live") / F.col("ref") - 1) * 100).cast("long").cast("string")
    reason = F.when(F.col("stage") == "price", F.concat(F.lit("last differs by "), off, F.lit(" percent"))).when(F.col("stage") == "overlap", F.concat(F.col("n").cast("string"), F.lit(" changes in common")))
    reason = reason.when(F.col("stage") == "correlation", "changes do not go together").otherwise("no price")
    return stages(p).filter("stage is not null").select("symbol", "stage", reason.alias("reason"))


@query(f"WITH {_TRACKED}, a AS (SELECT * FROM stages WHERE stage IS NULL) SELECT 'all' AS kind, 'all' AS value, count(*) AS n, round(quantile_cont(correlation, 0.5), 6) AS median_correlation, round(min(correlation), 6) AS least_correlation, round(quantile_cont(error_bp, 0.5), 3) AS median_error_bp, round(max(error_bp), 3) AS most_error_bp, round(quantile_cont(p50, 0.5), 6) + 0 AS median_premium, round(max(abs(p90)), 6) AS most_premium FROM a UNION ALL SELECT 'tier', tier, count(*), NULL, NULL, NULL, NULL, NULL, NULL FROM a GROUP BY tier UNION ALL SELECT 'stage', stage, count(*), NULL, NULL, NULL, NULL, NULL, NULL FROM stages WHERE stage IS NOT NULL GROUP BY stage")
def venue_summary(p: Panel) -> DataFrame:
    """The accepted symbols' figures, how many are of each tier, and how many each stage refused."""
    good = stages(p).filter("stage is null")
    m = lambda c: F.percentile(c, 0.5)
    figures = {"median_correlation": m("correlation"), "least_correlation": F.min("correlation"), "median_error_bp": F.round(m("error_bp"), 3), "most_error_bp": F.round(F.max("error_bp"), 3), "median_premium": m("p50"), "most_premium": F.max(F.abs("p90"))}
    one = good.agg(F.count("*").alias("n"), *(c.alias(k) for k, c in figures.items())).select(F.lit("all").alias("kind"), F.lit("all").alias("value"), "n", *figures)
    none = [F.lit(None).cast("double").alias(k) for k in figures]
    per = lambda kind, column, rows: rows.groupBy(column).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.col(column).alias("value"), "n", *none)
    return one.unionByName(per("tier", "tier", good)).unionByName(per("stage", "stage", stages(p).filter("stage is not null")))


@query(f"WITH {_TRACKED}, known AS (SELECT DISTINCT event_type || ':' || CAST(k AS VARCHAR) AS symbol FROM events, range(0, 9) t(k)) SELECT symbol, CASE WHEN s.symbol IS NULL THEN 'not verified' WHEN stage IS NULL THEN 'measured' ELSE 'refused' END AS state, CASE WHEN stage IS NULL THEN tier END AS tier, stage, CASE WHEN s.symbol IS NOT NULL AND stage IS NULL THEN round(p50, 6) + 0 END AS premium FROM known k LEFT JOIN stages s USING (symbol)")
def venue_cards(p: Panel) -> DataFrame:
    """What a card says of each known symbol's venue: measured with its tier, refused with the stage, or not verified."""
    k = F.explode(F.sequence(F.lit(0), F.lit(8)))
    known = p.table("events").select("event_type").distinct().select("event_type", k.alias("k")).select(F.concat("event_type", F.lit(":"), F.col("k").cast("string")).alias("symbol"))
    met = known.join(stages(p).withColumn("there", F.lit(True)), "symbol", "left")
    good = F.col("there") & F.col("stage").isNull()
    state = F.when(F.col("there").isNull(), "not verified").when(good, "measured").otherwise("refused")
    return met.select("symbol", state.alias("state"), F.when(good, F.col("tier")).alias("tier"), "stage", F.when(good, F.col("p50")).alias("premium"))


@query(f"WITH {_TRACKED}, d AS (SELECT symbol, 100 * (live / ref - 1) AS drift FROM stages WHERE live IS NOT NULL AND ref IS NOT NULL), o AS (SELECT *, row_number() OVER (ORDER BY abs(drift), symbol) - 1 AS place, count(*) OVER () AS n FROM d) SELECT any_value(n) AS n, round(max(abs(drift)) FILTER (WHERE place = n // 2), 6) AS median_drift, round(max(abs(drift)), 6) AS most_drift FROM o")
def venue_staleness(p: Panel) -> DataFrame:
    """How far last prices have drifted from the reference: the element in the middle, not interpolated, and the most."""
    d = stages(p).filter("live is not null and ref is not null").select("symbol", F.abs(100 * (F.col("live") / F.col("ref") - 1)).alias("drift"))
    placed = d.withColumn("place", F.row_number().over(Window.orderBy("drift", "symbol")) - 1).crossJoin(F.broadcast(d.agg(F.count("*").alias("n"))))  # a row for each symbol
    return placed.agg(F.first("n").alias("n"), F.max(F.when(F.col("place") == F.floor(F.col("n") / 2), F.col("drift"))).alias("median_drift"), F.max("drift").alias("most_drift"))


_BOOKS = "e AS (SELECT event_type AS instrument, date_trunc('hour', ts) AS ts, value AS price, 1 + event_id % 9 AS amount, avg(value) OVER (PARTITION BY event_type, date_trunc('hour', ts)) AS m FROM events WHERE value > 0), t AS (SELECT instrument, ts, max(price) FILTER (WHERE price < m) AS bid, min(price) FILTER (WHERE price >= m) AS ask FROM e GROUP BY ALL), mids AS (SELECT *, (bid + ask) / 2 AS mid FROM t)"


def _book_sql(value: str) -> str:
    far = lambda bp: f"coalesce(sum(amount * {value}) FILTER (WHERE abs(price / mid - 1) * 10000 <= {bp}), 0)"
    return f"""WITH {_BOOKS} SELECT instrument, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(any_value(bid), 6) AS bid, round(any_value(ask), 6) AS ask, round(any_value(mid), 6) AS mid, round(any_value((ask - bid) / mid * 10000), 4) AS spread_bp,
CASE WHEN any_value(mid) IS NOT NULL THEN round(least(sum(amount * price) FILTER (WHERE price = bid), sum(amount * price) FILTER (WHERE price = ask)), 4) END AS top, CASE WHEN any_value(mid) IS NOT NULL THEN round({far(200)}, 4) END AS depth_near, CASE WHEN any_value(mid) IS NOT NULL THEN round({far(2000)}, 4) END AS depth_far FROM e JOIN mids USING (instrument, ts) GROUP BY instrument, ts"""


def books(p: Panel) -> DataFrame:
    """An hour's events under their mean as bids, the others as asks."""
    e = p.table("events").filter("value > 0").select(F.col("event_type").alias("instrument"), F.date_trunc("hour", "ts").alias("ts"), F.col("value").alias("price"), (1 + F.col("event_id") % 9).cast("double").alias("amount"))
    e = e.join(e.groupBy("instrument", "ts").agg(F.avg("price").alias("m")), ["instrument", "ts"])
    side = lambda under: F.collect_list(F.when(under, F.struct("price", "amount")))
    return e.groupBy("instrument", "ts").agg(side(F.col("price") < F.col("m")).alias("bids"), side(F.col("price") >= F.col("m")).alias("asks"))  # a snapshot's levels


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")} | {c: F.round(c, 4) for c in ("spread_bp", "top", "depth_near", "depth_far")})


@query(_book_sql("mid"))
def order_books(p: Panel) -> DataFrame:
    """Best prices, spread and depth of hourly books, at the middle price; crossed books have none."""
    return _rounded(closed.order_book(books(p), ["instrument", "ts"], by_price=False, null_if_crossed=True, near=(200, 2000)))


@query(_book_sql("price"))
def order_books_by_price(p: Panel) -> DataFrame:
    """The same with each level at its own price, as the other venue counts."""
    return _rounded(closed.order_book(books(p), ["instrument", "ts"], by_price=True, null_if_crossed=False, near=(200, 2000)))


@query(f"SELECT instrument, count(*) AS n, {', '.join(f'round({sql}, 6) AS {name}' for name, sql in {'mean': 'avg(ret)', 'sd': 'stddev_samp(ret)', 'min': 'min(ret)', 'max': 'max(ret)', 'negative_pct': '100 * avg(CASE WHEN ret < 0 THEN 1 ELSE 0 END)', 'p10': 'quantile_cont(ret, 0.1)', 'median': 'quantile_cont(ret, 0.5)', 'p90': 'quantile_cont(ret, 0.9)'}.items())} FROM moves WHERE NOT open GROUP BY instrument")
def closed_distribution(p: Panel) -> DataFrame:
    """Hourly changes outside of the reference session, by instrument."""
    return closed.pooled(closed.moves(p.hourly).filter("not open"), ["instrument"], "ret")


@query("SELECT count(*) AS sessions, round(date_diff('day', min(session_date), max(session_date)) / 7, 6) AS weeks, round(count(*) / (date_diff('day', min(session_date), max(session_date)) / 7), 6) AS a_week, round(100 * (168 - count(*) / (date_diff('day', min(session_date), max(session_date)) / 7) * 6.5) / 168, 6) AS closed_share_pct FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session_date FROM orders WHERE isodow(o_orderdate) < 6)")
def reference_calendar(p: Panel) -> DataFrame:
    """Share of the week in which a market that opens 6.5 hours on the week days with orders is closed."""
    days = p.table("orders").select(F.to_date("o_orderdate").alias("d")).filter(F.weekday("d") < 5).distinct()
    weeks = F.datediff(F.max("d"), F.min("d")) / 7
    out = days.agg(F.count("*").alias("sessions"), weeks.alias("weeks")).withColumn("a_week", F.col("sessions") / F.col("weeks"))
    return out.withColumn("closed_share_pct", 100 * (168 - F.col("a_week") * 6.5) / 168)


@query("""WITH x AS (SELECT DISTINCT entity, event_date AS d FROM entity_events), y AS (SELECT DISTINCT 'Brand#' || CAST(11 + o_custkey % 25 // 5 * 10 + o_custkey % 5 AS VARCHAR) AS entity, CAST(o_orderdate AS DATE) AS d FROM orders),
m AS (SELECT x.entity, x.d, min(abs(date_diff('day', x.d, y.d))) AS days FROM x JOIN y ON y.entity = x.entity GROUP BY x.entity, x.d), o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY days, d) - 1 AS place, count(*) OVER (PARTITION BY entity) AS n FROM m)
SELECT entity, any_value(n) AS matched, count(*) FILTER (WHERE days = 0) AS same_day, count(*) FILTER (WHERE days <= 1) AS within_1, count(*) FILTER (WHERE days <= 3) AS within_3, count(*) FILTER (WHERE days <= 7) AS within_7, CAST(max(days) FILTER (WHERE place = n // 2) AS INT) AS median_days, CAST(max(days) AS INT) AS most_days FROM o GROUP BY entity""")
def event_agreement(p: Panel) -> DataFrame:
    """How close each entity's event days are to the nearest order of the customers that stand for it."""
    k = F.col("o_custkey") % 25
    right = p.table("orders").select(F.concat(F.lit("Brand#"), (11 + F.floor(k / 5) * 10 + k % 5).cast("string")).alias("entity"), F.to_date("o_orderdate").alias("d"))
    days = panel.nearest_date(p.entity_events.select("entity", F.col("event_date").alias("d")), right).filter("days is not null")
    within = lambda n: F.count_if(F.col("days") <= n)
    middle = scalar.upper_median(F.collect_list("days"))  # an entity's quarters
    return days.groupBy("entity").agg(F.count("*").alias("matched"), within(0).alias("same_day"), within(1).alias("within_1"), within(3).alias("within_3"), within(7).alias("within_7"), middle.cast("int").alias("median_days"), F.max("days").cast("int").alias("most_days"))


_CLAMP = "least(100, greatest(0, {}))"


@query(f"""WITH m AS (SELECT entity, session_idx, c, avg(c) OVER (PARTITION BY entity ORDER BY session_idx ROWS 49 PRECEDING) AS m50, avg(c) OVER (PARTITION BY entity ORDER BY session_idx ROWS 199 PRECEDING) AS m200 FROM grid), l AS (SELECT * FROM m WHERE session_idx = (SELECT max(session_idx) FROM grid)),
b AS (SELECT 100 * avg(CASE WHEN c > m50 THEN 1.0 ELSE 0 END) AS breadth50, 100 * avg(CASE WHEN c > m200 THEN 1.0 ELSE 0 END) AS breadth200 FROM l WHERE m50 IS NOT NULL),
v AS (SELECT 100 * sum(CASE WHEN value < latest THEN 1 ELSE 0 END) / greatest(1, count(*) - 1) AS pct FROM (SELECT * FROM series WHERE series_id = 'p:1-URGENT'), (SELECT arg_max(value, obs_date) AS latest FROM series WHERE series_id = 'p:1-URGENT')),
o AS (SELECT 100 * (l.c / l.m50 - 1) AS dist50, 100 * (l.c / l.m200 - 1) AS dist200, 100 * CAST(f.ret20 AS DOUBLE) AS ret20 FROM l JOIN bench ON l.entity = b LEFT JOIN features f ON f.entity = l.entity AND f.session_idx = l.session_idx),
s AS (SELECT breadth50, breadth200, pct, breadth50 * 0.25 + breadth200 * 0.20 + (100 - pct) * 0.20 + {_CLAMP.format("50 + coalesce(ret20, 0) * 8")} * 0.15 + ({_CLAMP.format("50 + dist50 * 5")} + {_CLAMP.format("50 + dist200 * 3")}) / 2 * 0.20 AS score FROM b, v, o)
SELECT round(breadth50, 4) AS breadth50, round(breadth200, 4) AS breadth200, round(pct, 4) AS percentile, round(score, 4) AS score, CASE WHEN score <= 25 THEN 'Extreme Fear' WHEN score <= 45 THEN 'Fear' WHEN score <= 55 THEN 'Neutral' WHEN score <= 75 THEN 'Greed' WHEN score > 75 THEN 'Extreme Greed' ELSE 'unknown' END AS band FROM s""", 4)
def sentiment_score(p: Panel) -> DataFrame:
    """The composite of breadth, trend and the volatility level's place, with its band, at the last session."""
    w = Window.partitionBy("entity").orderBy("session_idx")
    means = p.grid.filter(F.col("entity") == p.benchmark).select("session_idx", "c", *(F.avg("c").over(w.rowsBetween(-n + 1, 0)).alias(f"m{n}") for n in (50, 200)))
    last = means.orderBy(F.desc("session_idx")).limit(1)
    own = last.join(p.features.filter(F.col("entity") == p.benchmark).select("session_idx", "ret20"), "session_idx", "left")
    own = own.select((100 * (F.col("c") / F.col("m50") - 1)).alias("dist50"), (100 * (F.col("c") / F.col("m200") - 1)).alias("dist200"), (100 * F.col("ret20").cast("double")).alias("ret20"))
    b50, b200 = (sentiment.breadth(p.grid, n).select(F.col("breadth").alias(f"breadth{n}")) for n in (50, 200))
    vix = sentiment.latest_percentile(p.series.filter("series_id = 'p:1-URGENT'"), rows=None).select("percentile")
    met = own.crossJoin(b50).crossJoin(b200).crossJoin(vix)  # one row each
    score = sentiment.composite(*(F.col(c) for c in ("breadth50", "breadth200", "percentile", "ret20", "dist50", "dist200")))
    return met.select("breadth50", "breadth200", "percentile", score.alias("score"), scalar.sentiment_band(score).alias("band"))


_SNAP = "(SELECT h FROM (VALUES (1), (5), (10), (20), (40), (60)) t(h) ORDER BY abs(x - h), {} LIMIT 1)"
_Z = "((value - 20) / 10)"


@query(f"""WITH e AS (SELECT *, user_id % 80 - 3 AS x FROM events)
SELECT event_id, floor(value * 10 + 0.5::DOUBLE) / 10 AS rounded, CAST(CASE WHEN x > 0 THEN {_SNAP.format("h")} ELSE 5 END AS INT) AS horizon_short, CAST(CASE WHEN x > 0 THEN {_SNAP.format("h DESC")} ELSE 5 END AS INT) AS horizon_long, CAST(CASE WHEN user_id - 20 > 0 THEN greatest(10, least(200, user_id - 20)) ELSE 50 END AS INT) AS k,
CASE WHEN value <= 25 THEN 'Extreme Fear' WHEN value <= 45 THEN 'Fear' WHEN value <= 55 THEN 'Neutral' WHEN value <= 75 THEN 'Greed' ELSE 'Extreme Greed' END AS band, CASE WHEN value / 50 >= 0.95 AND value * 1.2 <= 60 THEN 'tight' WHEN value / 50 >= 0.85 THEN 'fair' WHEN value / 50 >= 0.5 THEN 'loose' ELSE 'rejected' END AS tier,
abs(value / 20 - 1) * 100 <= 7 AS close, round(0.5 * (1 + CASE WHEN {_Z} >= 0 THEN 1 ELSE -1 END * (1 - (((((1.061405429::DOUBLE * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-{_Z} * {_Z} / 2))), 6) AS cdf FROM (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs({_Z}) / sqrt(2::DOUBLE)) AS t FROM e)""")
def scalar_rules(p: Panel) -> DataFrame:
    """The scalar rules, applied to every event."""
    value, x = F.col("value"), (F.col("user_id") % 80 - 3).cast("int")
    return p.table("events").select(
        "event_id", scalar.round_half_up(value, 1).alias("rounded"), scalar.snap_horizon(x, False).cast("int").alias("horizon_short"), scalar.snap_horizon(x, True).cast("int").alias("horizon_long"), scalar.clamp_k(F.col("user_id") - 20).alias("k"), scalar.sentiment_band(value).alias("band"),
        scalar.tracking_tier(value / 50, value * 1.2).alias("tier"), scalar.price_ratio_ok(value, F.lit(20.0)).alias("close"), scalar.normal_cdf((value - 20) / 10).alias("cdf"),
    )


#: Start and factor of the 32-bit hash, and the factor of the length mixed in.
_START, _PRIME, _LENGTH, _MASK = 2166136261, 16777619, 2654435761, 0xFFFFFFFF


@query(f"""WITH k AS (SELECT conv_id, turn, '6|en|' || coalesce(text, '') AS key FROM conversations),
h AS (SELECT conv_id, turn, length(key) AS n, list_reduce(list_prepend({_START}::BIGINT, list_transform(string_split(key, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, x: (xor(a, x) * {_PRIME}) & {_MASK}) AS h FROM k)
SELECT conv_id, turn, printf('%08x', xor(h, (n * {_LENGTH}) & {_MASK})) AS digest FROM h""")
def text_digest(p: Panel) -> DataFrame:
    """A 32-bit digest of each turn's text over its UTF-16 units, mixed with their number, in eight hex digits."""
    key = F.concat(F.lit("6|en|"), F.coalesce("text", F.lit("")))
    units = F.filter(F.split(F.hex(F.encode(key, "UTF-16BE")), r"(?<=\G.{4})"), lambda x: x != "")
    step = lambda a, x: ((a.bitwiseXOR(F.conv(x, 16, 10).cast("long"))) * _PRIME).bitwiseAND(_MASK)
    h = F.aggregate(units, F.lit(_START).cast("long"), step)
    out = p.table("conversations").select("conv_id", "turn", units.alias("units"), h.alias("h"))
    mixed = F.col("h").bitwiseXOR((F.size("units") * F.lit(_LENGTH)).bitwiseAND(_MASK))
    return out.select("conv_id", "turn", F.lpad(F.lower(F.hex(mixed)), 8, "0").alias("digest"))
