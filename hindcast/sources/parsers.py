"""Parsers of stored feeds, event streams, candle arrays and JSON payloads; what can't be used is kept apart with its reason."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entities in the order of decoding, and the time formats of feeds (after the day of the week).
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'"))
TIMES = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def decoded(s: Column) -> Column:
    """Text of a CDATA section or with character entities, trimmed."""
    s = F.regexp_replace(s, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, plain in ENTITIES:
        s = F.regexp_replace(s, entity, plain)
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def _tagged(block: Column, tag: str) -> Column:
    return F.nullif(F.regexp_extract(block, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), F.lit(""))


def parse_rss(feeds: DataFrame, id_col: str, xml_col: str = "xml") -> DataFrame:
    """(id, position, title, link, published_at, reason): the items of each feed, from 1 in order.

    An item has its title, decoded; its link's text or ``href``; and its pubDate or dc:date as a UTC time,
    null where it can't be read. reason: no_title for items that can't be used, else null. A null
    feed, and one without items, has no rows.
    """
    read = feeds.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(xml_col).cast("string"), "<item>")).alias("position", "block")).filter("position > 0")
    title, when = decoded(_tagged(F.col("block"), "title")), F.regexp_replace(F.trim(F.coalesce(_tagged(F.col("block"), "pubDate"), _tagged(F.col("block"), "dc:date"))), r"^[A-Za-z]{3},\s*", "")
    link = F.coalesce(_tagged(F.col("block"), "link"), F.regexp_extract("block", r"<link[^>]*\shref=[\"']([^\"']+)[\"']", 1))
    time = F.coalesce(*(F.try_to_timestamp(when, F.lit(f)) for f in TIMES))
    reason = F.when(F.coalesce(title, F.lit("")) == "", "no_title")
    return read.select("id", "position", title.alias("title"), decoded(link).alias("link"), time.alias("published_at"), reason.alias("reason"))


def parse_sse(streams: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, position, payload, reason): the JSON of each ``data:`` line of an event stream, from 1 in order.

    Empty data is left out; reason is not_json for lines that aren't JSON, whose payload stays as text.
    """
    lines = F.split(F.col(text_col).cast("string"), r"\r?\n")
    data = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.regexp_replace(F.substring(x, 6, F.lit(2**31 - 1)), r"^\s+|\s+$", "")), lambda x: x != "")
    each = streams.select(F.col(id_col).alias("id"), F.posexplode(data).alias("at", "payload"))
    return each.select("id", (F.col("at") + 1).alias("position"), "payload", F.when(F.try_parse_json("payload").isNull(), "not_json").alias("reason"))


def parse_candles(rows: DataFrame, keys: list[str], array_col: str = "row") -> DataFrame:
    """(keys, ts, d, qv, c, h, l, o, bv, reason) of positional candles [time in seconds, quote volume, close, high, low, open, base volume, ...] of strings.

    reason: bad_time for rows without a finite time, else null; other fields that can't be read are null.
    """
    number = lambda i: F.nullif(F.expr(f"try_cast(get({array_col}, {i}) AS DOUBLE)"), F.lit(float("nan")))
    t = number(0)
    fine = t.isNotNull() & (F.abs(t) < 1e15)
    ts = F.when(fine, F.timestamp_seconds(t))
    return rows.select(*keys, ts.alias("ts"), F.to_date(ts).alias("d"), *(number(i).alias(n) for i, n in enumerate(("qv", "c", "h", "l", "o", "bv"), 1)), F.when(~fine, "bad_time").alias("reason"))


def check_echo(rows: DataFrame, request: str, want_interval: str, want_exchange: str) -> DataFrame:
    """Candles (request, time, close, ..., interval, exchange) in seconds, each with its reason if it can't be used.

    Times over 1e12 are milliseconds. reason: bad_row without a finite time or a positive close; trap if the
    request's answers name another interval or exchange than was asked for (the first in order where they
    name several), as a silent change of either would be measured as if it were the right one; else null.
    """
    t, c = F.expr("try_cast(time AS DOUBLE)"), F.expr("try_cast(close AS DOUBLE)")
    fine = F.coalesce(~F.isnan(t) & ~F.isnan(c) & (c > 0) & (F.abs(t) < 1e18), F.lit(False))
    rows = rows.withColumns({"ts": F.when(fine, F.floor(F.when(t > 1e12, t / 1000).otherwise(t) + 0.5).cast("long")), "close": c})
    first = F.struct("ts", "interval", "exchange")
    echoed = rows.filter("ts is not null").groupBy(request).agg(F.min_by(F.nullif(F.col("interval"), F.lit("")), F.when(F.col("interval") != "", first)).alias("said_interval"), F.min_by(F.nullif(F.col("exchange"), F.lit("")), F.when(F.col("exchange") != "", first)).alias("said_exchange"))
    trap = (F.col("said_interval") != want_interval) | (F.col("said_exchange") != want_exchange)
    reason = F.when(F.col("ts").isNull(), "bad_row").when(F.coalesce(trap, F.lit(False)), "trap")
    return rows.join(echoed, request, "left").withColumn("reason", reason).drop("said_interval", "said_exchange")


# --- JSON payloads ------------------------------------------------------------------------------

#: Nodes deeper than this are not looked at; the root has depth 0.
DEEPEST = 12
_YEAR = re.compile(r"(\d{4})-\d{2}-\d{2}", re.ASCII)


def walk(node, path: str = "$", label: str = "", depth: int = 0) -> Iterator[tuple[str, str, float]]:
    """(path, label, number) of every finite number in a JSON value, and of the year that a date-like string starts with."""
    if depth > DEEPEST or node is None or isinstance(node, bool):
        return
    if isinstance(node, (int, float)):
        if math.isfinite(node):
            yield path, label, float(node)
    elif isinstance(node, str):
        if found := _YEAR.match(node):
            yield path, label, float(found[1])
    elif isinstance(node, list):
        for i, x in enumerate(node):
            yield from walk(x, f"{path}[{i}]", label, depth + 1)
    else:
        for k, x in node.items():
            yield from walk(x, f"{path}.{k}", k, depth + 1)


def payload_numbers(payloads: DataFrame, id_col: str, json_col: str = "payload") -> DataFrame:
    """(id, path, label, number) of the numbers of each JSON text, with the name of the field that holds them.

    A text that isn't JSON has one row with nulls, so that it can be counted; a null one has none.
    """
    kind = dict(payloads.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("payload").to_pylist()):
                try:
                    own = list(walk(json.loads(text))) if text is not None else []
                except (ValueError, RecursionError, OverflowError):
                    own = [(None, None, None)]
                at += [i] * len(own)
                found += own
            columns = [pa.array([x[j] for x in found], t) for j, t in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *columns], ["id", "path", "label", "number"])

    read = payloads.select(F.col(id_col).alias("id"), F.col(json_col).cast("string").alias("payload"))
    return read.mapInArrow(run, f"id {kind}, path string, label string, number double")
