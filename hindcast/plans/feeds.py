"""Queries over stored feeds, streams, candles and payloads, which Spark writes out of the tables and reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sentiment import normal_title
from ..sources import datasets, parsers
from .queries import asked, query
from .staging import shared_folder
from .tables import Panel


def _hour(p: Panel) -> DataFrame:
    """Events with their feed: the events of a type within an hour."""
    return p.table("events").withColumn("feed", F.concat_ws("|", "event_type", F.date_format("ts", "yyyy-MM-dd HH")))


def _joined(rows: DataFrame, line, head: str, tail: str, name: str) -> DataFrame:
    """(feed, name): the lines of each feed in order of event."""
    held = rows.groupBy("feed").agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))).alias("x"))  # an hour of one type
    return held.select("feed", F.concat(F.lit(head), F.array_join(F.transform("x", lambda x: x["line"]), ""), F.lit(tail)).alias(name))


_PLACED = "SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS position, event_type || '|' || strftime(ts, '%Y-%m-%d %H') AS feed FROM events"


@query(f"""SELECT feed, CAST(position AS INT) AS position, CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type || ' & <' || user_id || '>' END AS title, 'http://feed.example/' || event_id || '?a=1&b=2' AS link,
CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS published_at, CASE WHEN event_id % 17 = 0 THEN 'no_title' END AS reason FROM ({_PLACED})""")
def feed_items(p: Panel) -> DataFrame:
    """Events written as items of hourly feeds, in CDATA or with entities, and parsed back; items without a title carry a reason."""
    text = F.concat(F.col("event_type"), F.lit(" & <"), F.col("user_id").cast("string"), F.lit(">"))
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title = F.when(F.col("event_id") % 17 == 0, F.lit("<title> </title>")).when(F.col("event_id") % 2 == 0, F.concat(F.lit('<title type="x"><![CDATA['), text, F.lit("]]></title>"))).otherwise(F.concat(F.lit("<title>\n"), escaped, F.lit("</title>")))
    url = F.concat(F.lit("http://feed.example/"), F.col("event_id").cast("string"))
    link = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('<link rel="x" href="'), url, F.lit('?a=1&amp;b=2"/>'))).otherwise(F.concat(F.lit("<link>"), url, F.lit("?a=1&amp;b=2</link>")))
    when = F.when(F.col("event_id") % 5 == 0, F.lit("<pubDate>some day</pubDate>")).when(F.col("event_id") % 2 == 0, F.concat(F.lit("<pubDate>"), F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>")))
    when = when.otherwise(F.concat(F.lit("<dc:date>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</dc:date>")))
    xml = _joined(_hour(p), F.concat(F.lit("<item>"), title, link, when, F.lit("</item>")), "<rss><channel><title>feed</title>", "</channel></rss>", "xml")
    items = parsers.parse_rss(xml, "feed")
    return items.select(F.col("id").alias("feed"), "position", F.nullif("title", F.lit("")).alias("title"), "link", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "reason")


@query(f"""SELECT feed, CAST(position AS INT) AS position, CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 19 = 0 THEN 'not_json' END AS reason FROM ({_PLACED})""")
def stream_messages(p: Panel) -> DataFrame:
    """Properties of events written as hourly event streams, and parsed back; broken ones carry a reason."""
    body = F.when(F.col("event_id") % 19 == 0, F.concat(F.lit("{broken "), F.col("props"))).otherwise(F.col("props"))
    lines = F.concat(F.lit("event: "), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "\r\n").otherwise("\n"), F.lit("data:"), F.when(F.col("event_id") % 3 == 0, "").otherwise(" "), body, F.lit("\n: remark\ndata:\n\n"))
    read = parsers.parse_sse(_joined(_hour(p), lines, "", "", "text"), "feed")
    k = F.when(F.col("reason").isNull(), F.get_json_object("payload", "$.k").cast("long"))
    return read.select(F.col("id").alias("feed"), "position", k.alias("k"), "reason")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS n FROM candles)
SELECT instrument, CASE WHEN n % 23 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts, round(c, 6) AS c, round(hi, 6) AS h, round(lo, 6) AS l, CASE WHEN n % 7 = 0 THEN NULL ELSE round(qv, 6) END AS qv, CASE WHEN n % 23 = 0 THEN 'bad_time' END AS reason FROM x""")
def positional_candles(p: Panel) -> DataFrame:
    """Hourly candles written as arrays of strings, and read back by position; rows without a time carry a reason."""
    n = F.row_number().over(Window.partitionBy("instrument").orderBy("ts"))
    text = lambda c: F.col(c).cast("string")
    rows = p.hourly.withColumn("n", n)
    time = F.when(F.col("n") % 23 == 0, "NaN").otherwise(F.unix_timestamp("ts").cast("string"))
    arrays = rows.select("instrument", F.array(time, F.when(F.col("n") % 7 == 0, "-").otherwise(text("qv")), text("c"), text("hi"), text("lo"), text("c"), F.lit("0"), F.lit("true")).alias("row"))
    read = parsers.parse_candles(arrays, ["instrument"])
    return read.select("instrument", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "c", "h", "l", "qv", "reason")


@query("""WITH x AS (SELECT *, date_trunc('day', ts) AS day, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS n FROM candles),
y AS (SELECT instrument, strftime(day, '%Y-%m-%d') AS day, CASE WHEN n % 29 = 0 THEN 'bad_row' WHEN day(day) % 10 = 3 OR day(day) % 10 = 7 THEN 'trap' END AS reason FROM x)
SELECT instrument, day, coalesce(reason, 'used') AS reason, count(*) AS n FROM y GROUP BY ALL""")
def echoed_candles(p: Panel) -> DataFrame:
    """Candles of each instrument and day as answers to a request for hours: days whose answers name another interval or venue are kept apart."""
    n = F.row_number().over(Window.partitionBy("instrument").orderBy("ts"))
    day, digit = F.date_format("ts", "yyyy-MM-dd"), F.dayofmonth("ts") % 10
    answers = p.hourly.withColumn("n", n).select(
        "instrument", day.alias("day"), F.concat_ws("|", "instrument", day).alias("request"), F.when(F.hour("ts") % 2 == 0, F.unix_timestamp("ts") * 1000).otherwise(F.unix_timestamp("ts")).cast("string").alias("time"),
        F.when(F.col("n") % 29 == 0, "0").otherwise(F.col("c").cast("string")).alias("close"), F.when(digit == 3, "1d").otherwise("1h").alias("interval"), F.when(digit == 7, "other").otherwise("venue").alias("exchange"),
    )
    read = parsers.check_echo(answers, "request", "1h", "venue")
    return read.groupBy("instrument", "day", F.coalesce("reason", F.lit("used")).alias("reason")).agg(F.count("*").alias("n"))


_DECODE = "trim(replace(replace(replace(replace(replace(regexp_replace({}, '(?s)<!\\[CDATA\\[(.*?)\\]\\]>', '\\1', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''))"


@query(f"SELECT page_id, {_DECODE.format('''regexp_extract(coalesce(html, ''), '(?s)<title(?:\\s[^>]*)?>(.*?)</title>', 1)''')} AS title FROM pages")
def page_titles(p: Panel) -> DataFrame:
    """The decoded title of every page; empty without one."""
    return p.table("pages").select("page_id", parsers.decoded(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?s)<title(?:\s[^>]*)?>(.*?)</title>", 1)).alias("title"))


_NESTED = "repeat('[', c_custkey % 15) || '{\"name\": \"' || c_name || '\", \"since\": \"1996-07-' || (10 + c_custkey % 20) || '\", \"balance\": ' || c_acctbal || ', \"ok\": true, \"nation\": {\"key\": ' || c_nationkey || ', \"none\": null, \"near\": [' || (c_custkey % 7) || ', \"x\", 2.5e1]}}' || repeat(']', c_custkey % 15)"


@query(f"""WITH j AS (SELECT c_custkey, c_custkey % 15 AS wraps, c_nationkey, c_acctbal, {_NESTED} AS payload FROM customer),
t AS (SELECT j.c_custkey, n.fullkey, n.key, n.atom, n.type, length(regexp_replace(n.fullkey, '[^.\\[]', '', 'g')) AS depth FROM j, json_tree(j.payload) n)
SELECT c_custkey, fullkey AS path, CASE WHEN n IS NOT NULL THEN label END AS label, round(n, 6) AS number FROM (
  SELECT c_custkey, fullkey, regexp_extract(fullkey, '\\.([a-z]+)(?:\\[[0-9]+\\])*$', 1) AS label, CASE WHEN type IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN CAST(atom AS DOUBLE) WHEN type = 'VARCHAR' AND regexp_matches(CAST(atom AS VARCHAR), '^"?\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN CAST(regexp_extract(CAST(atom AS VARCHAR), '(\\d{{4}})', 1) AS DOUBLE) END AS n FROM t WHERE depth <= 12) WHERE n IS NOT NULL""")
def json_numbers(p: Panel) -> DataFrame:
    """Every number of nested customer records, with its path, down to the depth limit."""
    payload = F.expr("""concat(repeat('[', int(c_custkey % 15)), '{"name": "', c_name, '", "since": "1996-07-', 10 + c_custkey % 20, '", "balance": ', c_acctbal, ', "ok": true, "nation": {"key": ', c_nationkey, ', "none": null, "near": [', c_custkey % 7, ', "x", 2.5e1]}}', repeat(']', int(c_custkey % 15)))""")
    made = p.table("customer").select("c_custkey", payload.alias("payload"))
    return parsers.payload_numbers(made, "c_custkey").withColumnRenamed("id", "c_custkey")


@query("SELECT 'bars' AS name, count(*) AS n, count(DISTINCT entity) AS n_keys, round(sum(v), 2) AS total FROM bars UNION ALL SELECT 'series', count(*), count(DISTINCT series_id), round(sum(value), 2) FROM series UNION ALL SELECT 'sessions', count(*), count(DISTINCT session_date), round(sum(CAST(session_idx AS DOUBLE)), 2) FROM calendar", 2)
def dataset_tables(p: Panel) -> DataFrame:
    """The panel's tables written as a versioned set, and counted as its manifest names them."""
    path = f"{shared_folder(p.spark)}/dataset-{p.spark.sparkContext.applicationId}"
    version = datasets.write_dataset(p.spark, path, {"bars": p.bars, "series": p.series, "sessions": p.calendar}, by={"bars": ["entity"]})
    read = datasets.read_dataset(p.spark, path, version)
    one = lambda name, key, x: read[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.countDistinct(key).alias("n_keys"), F.sum(F.col(x).cast("double")).alias("total"))
    return one("bars", "entity", "v").unionByName(one("series", "series_id", "value")).unionByName(one("sessions", "session_date", "session_idx"))


# --- signals of a card --------------------------------------------------------------------------

#: Types that have headlines of their own, the one whose headlines are the market's, headlines of each, and macro values that a card falls back on.
WITH_NEWS, MARKET, MOST_NEWS = ("click", "view"), "error", 5
MACRO = ("vix", "slope", "d_rate90", "bei_chg20", "usd_chg20", "oil_chg20", "hy_chg20")
_NEWS = f"""raw AS (SELECT event_id AS pos, event_type AS symbol, event_type || ' ' || user_id % 40 || '!' AS title, ts FROM events),
news AS (SELECT symbol, title, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC NULLS LAST, pos) AS rank FROM (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, trim(regexp_replace(lower(title), '[^a-z0-9一-龥]+', ' ', 'g')) ORDER BY pos) = 1) QUALIFY rank <= {MOST_NEWS})"""


@query(f"""WITH {_NEWS}, cards AS (SELECT DISTINCT event_type AS symbol FROM events),
items AS (SELECT c.symbol, 1 AS tier, rank, title, c.symbol AS for_symbol FROM cards c JOIN news n ON n.symbol = c.symbol WHERE c.symbol IN {WITH_NEWS} UNION ALL SELECT c.symbol, 2, rank, title, NULL FROM cards c, news n WHERE n.symbol = '{MARKET}'),
told AS (SELECT symbol, series_id AS label, round(arg_max(value, obs_date), 4) AS value, 'snapshot' AS source FROM series, cards WHERE symbol IN {WITH_NEWS} AND series_id LIKE 's:%' GROUP BY symbol, series_id),
state AS (SELECT session_idx, {", ".join(MACRO)} FROM features, bench WHERE valid AND entity = b QUALIFY row_number() OVER (ORDER BY session_idx DESC) = 1),
card AS (SELECT symbol, label, round(CAST(value AS DOUBLE), 4) AS value, 'card' AS source FROM cards, (UNPIVOT (SELECT {", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in MACRO)} FROM state) ON {", ".join(MACRO)} INTO NAME label VALUE value) WHERE symbol NOT IN (SELECT symbol FROM told))
SELECT symbol, 'news' AS kind, CAST(row_number() OVER (PARTITION BY symbol ORDER BY tier, rank) AS INT) AS ordinal, title AS label, for_symbol, CAST(NULL AS DOUBLE) AS value, CASE tier WHEN 1 THEN 'symbol' ELSE 'market' END AS source FROM items
UNION ALL SELECT symbol, 'macro', CAST(row_number() OVER (PARTITION BY symbol ORDER BY label) AS INT), label, NULL, value, source FROM (FROM told UNION ALL FROM card)""", 4)
def card_signals(p: Panel) -> DataFrame:
    """What surrounds each symbol: its own headlines first, then the market's, and macro values, from the snapshot or else from the card."""
    titled = p.table("events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("symbol"), F.concat("event_type", F.lit(" "), (F.col("user_id") % 40).cast("string"), F.lit("!")).alias("title"), "ts")
    once = titled.groupBy("symbol", normal_title(F.col("title")).alias("norm")).agg(F.min(F.struct("pos", "title", "ts")).alias("x")).select("symbol", "x.*")
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc_nulls_last(), "pos")
    news = once.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= MOST_NEWS).select("symbol", "rank", "title")
    cards = titled.select("symbol").distinct()
    own = news.filter(F.col("symbol").isin(*WITH_NEWS)).select("symbol", F.lit(1).alias("tier"), "rank", "title", F.col("symbol").alias("for_symbol"))
    market = news.filter(F.col("symbol") == MARKET).select(F.lit(2).alias("tier"), "rank", "title", F.lit(None).cast("string").alias("for_symbol"))
    items = own.unionByName(cards.join(F.broadcast(market)))  # MOST_NEWS rows of the market
    ordinal = F.row_number().over(Window.partitionBy("symbol").orderBy("tier", "rank"))
    items = items.select("symbol", F.lit("news").alias("kind"), ordinal.alias("ordinal"), F.col("title").alias("label"), "for_symbol", F.lit(None).cast("double").alias("value"), F.when(F.col("tier") == 1, "symbol").otherwise("market").alias("source"))

    last = p.series.filter(F.col("series_id").startswith("s:")).groupBy("series_id").agg(F.max_by("value", "obs_date").alias("value")).select(F.col("series_id").alias("label"), "value")
    told = cards.filter(F.col("symbol").isin(*WITH_NEWS)).join(F.broadcast(last)).withColumn("source", F.lit("snapshot"))  # a row for each status
    _, q = asked(p)
    state = p.features.filter((F.col("entity") == p.benchmark) & (F.col("session_idx") == q)).select(*(F.col(m).cast("double").alias(m) for m in MACRO))
    fall_back = state.select(F.inline(F.array(*(F.struct(F.lit(m).alias("label"), F.col(m).alias("value")) for m in MACRO)))).filter("value is not null")
    card = cards.join(told.select("symbol").distinct(), "symbol", "left_anti").join(F.broadcast(fall_back)).withColumn("source", F.lit("card"))  # seven values at most
    macro = told.unionByName(card)
    macro = macro.select("symbol", F.lit("macro").alias("kind"), F.row_number().over(Window.partitionBy("symbol").orderBy("label")).alias("ordinal"), "label", F.lit(None).cast("string").alias("for_symbol"), "value", "source")
    return items.unionByName(macro)
