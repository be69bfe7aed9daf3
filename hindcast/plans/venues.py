"""Queries over two venues that measure the same symbols, listings of the library, calendar lookups and numerals in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .queries import query, r
from .tables import Panel

#: Events of even users stand for the first venue, those of odd ones for the second; a symbol is a user's hundred within a type. A venue lists what trades there at least nine tenths as often as its symbols do on average.
_MEASURED = "measured AS (SELECT * EXCLUDE (usual) FROM (SELECT *, avg(n) OVER (PARTITION BY venue) AS usual FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'first' ELSE 'second' END AS venue, event_type || ':' || CAST(user_id // 2 % 7 AS VARCHAR) AS symbol, count(*) AS n, avg(value) AS mean, arg_max(value, (ts, event_id)) AS last FROM events WHERE value > 0 GROUP BY ALL)) WHERE 10 * n >= 9 * usual), one AS (SELECT * FROM measured WHERE venue = 'first'), two AS (SELECT * FROM measured WHERE venue = 'second'), known AS (SELECT DISTINCT event_type || ':' || CAST(k AS VARCHAR) AS symbol FROM events, range(0, 9) t(k))"


def measured(p: Panel, venue: str) -> DataFrame:
    """(symbol, n, mean, last) of what one venue lists."""
    symbol = F.concat("event_type", F.lit(":"), (F.floor(F.col("user_id") / 2) % 7).cast("string"))
    own = p.table("events").filter((F.col("value") > 0) & ((F.col("user_id") % 2 == 0) if venue == "first" else (F.col("user_id") % 2 != 0))).withColumn("symbol", symbol)
    traded = own.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))
    return traded.join(F.broadcast(traded.agg(F.avg("n").alias("usual"))), 10 * F.col("n") >= 9 * F.col("usual")).drop("usual")


def both(p: Panel) -> DataFrame:
    two = measured(p, "second").select("symbol", *(F.col(c).alias(f"{c}2") for c in ("n", "mean", "last")))
    return measured(p, "first").join(two, "symbol")


@query(f"WITH {_MEASURED} SELECT symbol, one.n AS n_first, two.n AS n_second, round(one.mean - two.mean, 6) + 0 AS difference, round(10000 * (one.last / two.last - 1), 4) + 0 AS last_bp FROM one JOIN two USING (symbol)")
def cross_venue(p: Panel) -> DataFrame:
    """Symbols that both venues measured, with the differences of their figures."""
    return both(p).select("symbol", F.col("n").alias("n_first"), F.col("n2").alias("n_second"), (F.col("mean") - F.col("mean2")).alias("difference"), F.round(1e4 * (F.col("last") / F.col("last2") - 1), 4).alias("last_bp"))


@query(f"WITH {_MEASURED} SELECT count(*) AS n, round(quantile_cont(one.mean - two.mean, 0.5), 6) AS median, round(min(one.mean - two.mean), 6) AS least, round(max(one.mean - two.mean), 6) AS most, sum(CASE WHEN one.mean > two.mean THEN 1 ELSE 0 END)::BIGINT AS n_first_higher FROM one JOIN two USING (symbol)")
def cross_venue_summary(p: Panel) -> DataFrame:
    """The distribution of the differences between two venues."""
    d = F.col("mean") - F.col("mean2")
    return both(p).agg(F.count("*").alias("n"), F.percentile(d, 0.5).alias("median"), F.min(d).alias("least"), F.max(d).alias("most"), F.sum((d > 0).cast("long")).alias("n_first_higher"))


@query(f"WITH {_MEASURED} SELECT symbol, CASE WHEN one.symbol IS NOT NULL THEN 'first' WHEN two.symbol IS NOT NULL THEN 'second' ELSE 'none' END AS source, round(coalesce(one.last, two.last), 6) AS last FROM known LEFT JOIN one USING (symbol) LEFT JOIN two USING (symbol)")
def venue_priority(p: Panel) -> DataFrame:
    """For every known symbol the first venue's figure, else the second's, else none."""
    k = F.explode(F.sequence(F.lit(0), F.lit(8)))
    known = p.table("events").select("event_type").distinct().select("event_type", k.alias("k")).select(F.concat("event_type", F.lit(":"), F.col("k").cast("string")).alias("symbol"))
    one, two = measured(p, "first").select("symbol", F.col("last").alias("a")), measured(p, "second").select("symbol", F.col("last").alias("b"))
    met = known.join(one, "symbol", "left").join(two, "symbol", "left")
    return met.select("symbol", F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").otherwise("none").alias("source"), F.coalesce("a", "b").alias("last"))


@query(f"WITH {_MEASURED} SELECT symbol, CASE WHEN one.symbol IS NULL AND two.symbol IS NULL THEN 'uncovered' WHEN two.symbol IS NULL THEN 'first only' WHEN one.symbol IS NULL THEN 'second only' ELSE 'both' END AS coverage FROM known LEFT JOIN one USING (symbol) LEFT JOIN two USING (symbol)")
def venue_sets(p: Panel) -> DataFrame:
    """Union, intersection and difference of what the venues list, over all known symbols."""
    k = F.explode(F.sequence(F.lit(0), F.lit(8)))
    known = p.table("events").select("event_type").distinct().select("event_type", k.alias("k")).select(F.concat("event_type", F.lit(":"), F.col("k").cast("string")).alias("symbol"))
    one, two = measured(p, "first").select("symbol"), measured(p, "second").select("symbol")
    parts = {"both": one.intersect(two), "first only": one.subtract(two), "second only": two.subtract(one), "uncovered": known.subtract(one.union(two))}
    out = None
    for name, part in parts.items():
        part = part.withColumn("coverage", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT entity, min(session_idx) FILTER (WHERE valid) AS first_idx, max(session_idx) FILTER (WHERE valid) AS last_idx, count(*) FILTER (WHERE valid) AS n_valid, round(arg_max(c, session_idx) FILTER (WHERE c IS NOT NULL), 6) AS last_close FROM features GROUP BY entity")
def library_listing(p: Panel) -> DataFrame:
    """By entity: first and last valid session, number of valid ones and the last close."""
    at = F.when(F.col("valid"), F.col("session_idx"))
    return p.features.groupBy("entity").agg(F.min(at).alias("first_idx"), F.max(at).alias("last_idx"), F.count(at).alias("n_valid"), F.max_by("c", F.when(F.col("c").isNotNull(), F.col("session_idx"))).alias("last_close"))


@query(f"SELECT feature, count(*) AS n, {r('avg(x)', digits=4).replace('AS avg(x)', 'AS mean')}, {r('stddev_samp(x)', digits=4).replace('AS stddev_samp(x)', 'AS sd')} FROM (SELECT feature, session_idx, CAST(x AS DOUBLE) AS x FROM long) WHERE session_idx < 200 GROUP BY feature", 4)
def global_stats(p: Panel) -> DataFrame:
    """Mean and deviation of each feature over all rows before a cut-off session."""
    from ..operators.standardise import unpivot

    x = F.col("x").cast("double")
    return unpivot(p.features).filter("session_idx < 200").groupBy("feature").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))


@query("SELECT CAST(d AS VARCHAR) AS d, session_idx FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) o ASOF LEFT JOIN calendar k ON o.d >= k.session_date")
def session_on_or_before(p: Panel) -> DataFrame:
    """For each order date the last session on or before it, null before the first; one sort of dates, no pairs."""
    dates = p.table("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct().select("d", F.lit(None).cast("int").alias("session_idx"), F.lit(True).alias("asked"))
    both = dates.unionByName(p.calendar.select(F.col("session_date").alias("d"), "session_idx", F.lit(False).alias("asked")))
    w = Window.orderBy("d", "asked")  # calendar-sized: distinct dates
    return both.withColumn("session_idx", F.last("session_idx", True).over(w)).filter("asked").select("d", "session_idx")


@query("SELECT entity, CAST(max(event_date) AS VARCHAR) AS event_date, max(k.session_idx) AS session_idx FROM (SELECT entity, max(event_date) AS event_date FROM entity_events WHERE event_date <= DATE '1997-06-30' GROUP BY entity) e LEFT JOIN calendar k ON k.session_date <= e.event_date GROUP BY entity")
def last_event(p: Panel) -> DataFrame:
    """By entity the last event on or before a day, at the last session on or before it."""
    events = p.entity_events.filter("event_date <= DATE '1997-06-30'").groupBy("entity").agg(F.max("event_date").alias("event_date"))
    both = events.select("entity", "event_date", F.lit(None).cast("int").alias("session_idx")).unionByName(p.calendar.select(F.lit(None).cast("string").alias("entity"), F.col("session_date").alias("event_date"), "session_idx"))
    w = Window.orderBy("event_date", F.col("entity").isNotNull())  # an event an entity and the calendar
    return both.withColumn("session_idx", F.last("session_idx", True).over(w)).filter("entity is not null").select("entity", "event_date", "session_idx")


_PLAIN = r"\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}"
_NUMERAL = r"\d+(?:\.\d+)?%?"


@query(f"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '{_PLAIN}', ' ', 'g'), '{_NUMERAL}')) AS numeral FROM documents),
k AS (SELECT DISTINCT unnest(regexp_extract_all(regexp_replace(text, '{_PLAIN}', ' ', 'g'), '{_NUMERAL}')) AS numeral FROM benchmark)
SELECT doc_id, numeral, count(*) AS n FROM n WHERE numeral NOT IN (SELECT numeral FROM k) GROUP BY ALL""")
def unsupported_numerals(p: Panel) -> DataFrame:
    """Numerals of every document, dates and times masked, that no stated text holds; repeats are counted."""
    masked = lambda df: F.regexp_replace("text", _PLAIN, " ")
    found = lambda df: F.explode(F.regexp_extract_all(masked(df), F.lit(_NUMERAL), F.lit(0))).alias("numeral")
    docs, stated = p.table("documents"), p.table("benchmark")
    counted = docs.select("doc_id", found(docs)).groupBy("doc_id", "numeral").agg(F.count("*").alias("n"))
    return counted.join(stated.select(found(stated)).distinct(), "numeral", "left_anti").select("doc_id", "numeral", "n")
