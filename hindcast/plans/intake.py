"""Queries that read JSON answers of sources, which Spark writes out of the tables, and views that join metadata to the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import panel
from ..operators.stress import SCENARIOS
from ..sources import datasets, readers
from .queries import query
from .scores import _RISK, bands, risks
from .staging import shared_folder
from .tables import Panel


@query("SELECT strftime(obs_date, '%Y-%m-%d') AS obs_date, round(value, 6) AS value FROM series WHERE series_id = 'all' AND month(obs_date) <> 7")
def index_points(p: Panel) -> DataFrame:
    """Points of an index, read from yearly JSON answers with times in seconds; those without a number are left out."""
    own = p.series.filter("series_id = 'all'")
    point = F.struct(F.when(F.month("obs_date") == 7, "n/a").otherwise(F.col("value").cast("string")).alias("value"), F.unix_timestamp(F.col("obs_date").cast("timestamp")).cast("string").alias("timestamp"))
    answers = own.groupBy(F.year("obs_date").alias("year")).agg(F.to_json(F.struct(F.collect_list(point).alias("data"))).alias("answer"))  # a year's months
    read = answers.select(F.inline(F.from_json("answer", "data array<struct<value:string,timestamp:string>>")["data"]))
    return read.select(F.to_date(F.timestamp_seconds(F.expr("try_cast(timestamp AS LONG)"))).alias("obs_date"), F.expr("try_cast(value AS DOUBLE)").alias("value")).dropna()


_HITS = "hits AS (SELECT DISTINCT entity, event_date, CASE WHEN CAST(regexp_extract(entity, '[0-9]+') AS INT) % 3 = 0 THEN '6-K' ELSE '8-K' END AS form FROM entity_events)"


@query(f"""WITH RECURSIVE {_HITS}, d AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY event_date) AS rn FROM hits),
k AS (SELECT entity, form, event_date AS d, rn, event_date AS kept FROM d WHERE rn = 1 UNION ALL SELECT d.entity, d.form, d.event_date, d.rn, CASE WHEN date_diff('day', k.kept, d.event_date) > 100 THEN d.event_date ELSE k.kept END FROM k JOIN d ON d.entity = k.entity AND d.rn = k.rn + 1)
SELECT entity, form, CAST(d AS VARCHAR) AS d FROM k WHERE d = kept""")
def filing_dates(p: Panel) -> DataFrame:
    """Report dates from search answers: all pages' hits, the second form only for entities without the first, and one date a cluster."""
    third = F.regexp_extract("entity", "[0-9]+", 0).cast("int") % 3 == 0
    source = lambda form: F.to_json(F.struct(F.collect_list(F.struct(F.struct(F.col("event_date").cast("string").alias("file_date")).alias("_source"))).alias("hits")))
    events = p.entity_events.withColumn("page", F.explode(F.array(F.quarter("event_date") % 2, F.lit(0))))  # pages overlap
    first = events.filter(~third).withColumn("form", F.lit("8-K"))
    second = events.withColumn("form", F.lit("6-K"))
    answers = first.unionByName(second).groupBy("entity", "form", "page").agg(source("form").alias("answer"))  # an entity's quarters
    hits = answers.select("entity", "form", F.inline(F.from_json("answer", "hits array<struct<_source:struct<file_date:string>>>")["hits"]))
    dates = hits.select("entity", "form", F.try_to_date("_source.file_date").alias("d")).dropna().distinct()
    kept = readers.first_source(dates.filter("form = '8-K'"), dates.filter("form = '6-K'"), "entity")
    return panel.date_clusters(kept, 100).join(kept.select("entity", "form").distinct(), "entity").select("entity", "form", "d")


#: Parts of an index and their labels.
PARTS = {"click": "Momentum", "view": "Breadth", "purchase": "Strength", "error": "Volatility"}


@query(f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, event_type AS key, CASE event_type {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in PARTS.items())} END AS label, round(max(value), 6) AS score FROM events WHERE event_type IN {tuple(PARTS)} AND day(ts) % 6 <> 0 GROUP BY CAST(ts AS DATE), event_type")
def index_components(p: Panel) -> DataFrame:
    """Parts of a daily index, read from JSON answers with a field for each; unknown fields and scores that are no number are left out."""
    e = p.table("events").withColumn("d", F.to_date("ts")).groupBy("d", "event_type").agg(F.max("value").alias("v"))
    score = F.when(F.dayofmonth("d") % 6 == 0, "-").otherwise(F.col("v").cast("string"))
    answers = e.groupBy("d").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", F.struct(score.alias("score")))))).alias("answer"))  # the types of a day
    labels = F.create_map(*(F.lit(x) for kv in PARTS.items() for x in kv))
    read = answers.select("d", F.explode(F.from_json("answer", "map<string, struct<score:string>>")).alias("key", "x"))
    return read.select("d", "key", F.try_element_at(labels, "key").alias("label"), F.expr("try_cast(x.score AS DOUBLE)").alias("score")).filter("label is not null and score is not null").select(F.col("d").cast("string").alias("d"), "key", "label", "score")


@query("WITH c AS (SELECT n_name AS symbol, n_nationkey % 3 = 0 AS flagged, r_name AS exchange FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT c.symbol, c.flagged, (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT exchange AS e FROM c)) AS exchanges, EXISTS (SELECT 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = c.symbol) AS listed FROM c")
def catalog_flags(p: Panel) -> DataFrame:
    """Symbols that a catalog flags, the exchanges it names, and whether the symbol is listed here: a flag is no listing."""
    nation = p.table("nation").join(F.broadcast(p.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    rows = nation.select(F.to_json(F.struct(F.col("n_name").alias("symbol"), (F.col("n_nationkey") % 3 == 0).alias("is_rwa"), F.col("r_name").alias("exchange"))).alias("row"))
    catalog = rows.select(F.from_json("row", "symbol string, is_rwa boolean, exchange string").alias("x")).select("x.*")
    named = catalog.agg(F.array_join(F.sort_array(F.collect_set("exchange")), ",").alias("exchanges"))
    here = p.table("supplier").select("s_nationkey").distinct().join(p.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("symbol"), F.lit(True).alias("here"))
    return catalog.join(F.broadcast(named)).join(here, "symbol", "left").select("symbol", F.col("is_rwa").alias("flagged"), "exchanges", F.coalesce("here", F.lit(False)).alias("listed"))


@query("""WITH s AS (SELECT DISTINCT upper(replace(n_name, ' ', '')) AS symbol FROM nation), b AS (SELECT DISTINCT upper(replace(n_name, ' ', '')) || suffix AS base FROM nation, (VALUES (''), ('X'), ('ON'), ('BSTX'), ('S')) t(suffix))
SELECT CASE WHEN base = symbol THEN '(none)' ELSE substr(base, length(symbol) + 1) END AS suffix, count(*) AS n, count(DISTINCT symbol) AS n_symbols FROM s, b WHERE starts_with(base, symbol) AND length(base) <= length(symbol) + 3 GROUP BY 1""")
def issuer_families(p: Panel) -> DataFrame:
    """Accepted pairs by the suffix that tells their issuer."""
    name = F.replace(F.col("n_name"), F.lit(" "), F.lit(""))
    nation = p.table("nation").select(name.alias("symbol"))
    pairs = nation.withColumn("x", F.explode(F.array(*map(F.lit, ("", "X", "ON", "BSTX", "S"))))).select(F.concat("symbol", "x").alias("base"), F.lit("USDT").alias("quote"))
    return panel.prefix_candidates(nation, pairs, "USDT").groupBy("suffix").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("n_symbols"))


_VENUE = next(s.id for s in SCENARIOS if s.kind == "venue")


@query(f"WITH s(scenario, kind) AS (VALUES {', '.join(f'''('{s.id}', '{s.kind}')''' for s in SCENARIOS)}), m AS (SELECT round(100 * sum(CASE WHEN open THEN 0 ELSE abs(ret) END) / sum(abs(ret)), 2) AS pct FROM moves) SELECT scenario, kind, CASE WHEN kind = 'venue' THEN pct END AS closed_move_pct FROM s, m")
def scenario_caveats(p: Panel) -> DataFrame:
    """The registry of scenarios; the one on a venue's closed hours carries the share of movement that was measured there."""
    from ..operators import closed

    m = closed.moves(p.hourly)
    share = m.agg(F.round(100 * F.sum(F.when(F.col("open"), 0).otherwise(F.abs("ret"))) / F.sum(F.abs("ret")), 2).alias("pct"))
    listed = p.spark.createDataFrame([(s.id, s.kind) for s in SCENARIOS], "scenario string, kind string")
    return listed.join(F.broadcast(share)).select("scenario", "kind", F.when(F.col("scenario") == _VENUE, F.col("pct")).alias("closed_move_pct"))


@query("""WITH b AS (SELECT entity, min(session_date) AS first_session, count(*) AS n FROM bars GROUP BY entity), m AS (SELECT p_brand AS entity, min(p_partkey) AS key, CAST(min(l_shipdate) AS DATE) AS first_ship FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_brand)
SELECT m.entity, CAST(first_session AS VARCHAR) AS first_session, CAST(first_ship AS VARCHAR) AS first_ship, first_session = CAST(date_trunc('week', first_ship) AS DATE) AS agrees FROM m LEFT JOIN b USING (entity)""")
def profile_check(p: Panel) -> DataFrame:
    """Each entity's own first session beside its metadata's first date, and whether they agree; entities without bars stay."""
    own = p.bars.groupBy("entity").agg(F.min("session_date").alias("first_session"))
    lines = p.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_shipdate").alias("first"))
    told = p.table("part").join(lines, "p_partkey", "left").groupBy(F.col("p_brand").alias("entity")).agg(F.to_date(F.min("first")).alias("first_ship"))
    met = told.join(own, "entity", "left")
    return met.select("entity", "first_session", "first_ship", (F.col("first_session") == F.date_trunc("week", "first_ship").cast("date")).alias("agrees"))


@query(f"{_RISK}, usable AS (SELECT * FROM predicted WHERE half > 0 AND era = 'test') SELECT predictor AS name, count(*) AS n, round(avg(y), 6) + 0 AS mean FROM usable GROUP BY predictor UNION ALL SELECT 'path risk', count(*), round(avg(y), 6) FROM risks")
def validation_tables(p: Panel) -> DataFrame:
    """The validation's tables written as a versioned set, and counted as its manifest names them."""
    path = f"{shared_folder(p.spark)}/validation-{p.spark.sparkContext.applicationId}"
    version = datasets.write_dataset(p.spark, path, {"bands": bands(p), "risks": risks(p)}, by={"bands": ["predictor"]})
    read = datasets.read_dataset(p.spark, path, version)
    return read["bands"].groupBy(F.col("predictor").alias("name")).agg(F.count("*").alias("n"), F.avg("y").alias("mean")).unionByName(read["risks"].groupBy(F.lit("path risk").alias("name")).agg(F.count("*").alias("n"), F.avg("y").alias("mean")))
