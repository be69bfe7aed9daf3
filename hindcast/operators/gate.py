"""Numerals of prose held against what a table says: tokens with places, near matches, and figures cited with a date."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is quoted and no claim (code, dates, times), what a numeral is, and what makes it a percentage.
QUOTED = re.compile(r"`[^`]*`")
DATED = re.compile(r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}:\d{2}(?::\d{2})?\b|\b\d{4}/\d{1,2}/\d{1,2}\b", re.ASCII)
NUMERAL = re.compile(r"(?<![\w.:/-])(-?\d{1,3}(?:,\d{3})*(?:\.\d+)?|-?\d+(?:\.\d+)?)(?![\w])", re.ASCII)
PERCENT = re.compile(r"\s*(%|percent|pp|percentage points)", re.IGNORECASE)
RELATIVE, SMALLEST, AROUND = 0.005, 1e-9, 60


def numerals(text: str) -> Iterator[tuple[int, str, str, bool]]:
    """(place, numeral, context, percent) of each numeral outside of code, dates and times; places count code points from 0."""
    blank = lambda m: " " * len(m[0])
    masked = DATED.sub(blank, QUOTED.sub(blank, text))
    for m in NUMERAL.finditer(masked):
        around = re.sub(r"\s+", " ", text[max(0, m.start() - AROUND) : m.end() + AROUND]).strip()
        yield m.start(), m[0], around, bool(PERCENT.match(text[m.end() : m.end() + 14]))


def numeral_tokens(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, place, numeral, context, percent, value): the numerals of every text, a row for each. A null text has none."""
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = list(numerals(text or ""))
                at += [i] * len(own)
                found += own
            columns = [pa.array([x[j] for x in found], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *columns], ["id", "place", "numeral", "context", "percent"])

    read = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = read.mapInArrow(run, f"id {kind}, place long, numeral string, context string, percent boolean")
    return made.withColumn("value", F.replace("numeral", F.lit(","), F.lit("")).cast("double"))


def surface_forms(x: Column) -> Column:
    """Values as which a number may be printed: itself, as a percentage and as a fraction, each whole and with up to three decimals."""
    near = lambda v: [v, *(F.floor(v * 10**d + 0.5) / 10**d for d in range(4))]
    forms = F.array(*near(x), *near(x * 100), *(F.when(F.abs(x) >= 1, v) for v in near(x / 100)))
    return F.array_distinct(F.filter(forms, lambda v: v.isNotNull()))


def _bin(x: Column) -> Column:
    """The place of x on a logarithmic scale on which near values are at most one place apart; tiny ones share a place."""
    width = -math.log(1 - RELATIVE)
    return F.when(F.abs(x) >= SMALLEST, F.floor(F.ln(F.abs(x)) / width)).otherwise(F.floor(F.lit(math.log(SMALLEST) / width)) - 1)


def near(x: Column, y: Column) -> Column:
    return (x == y) | (F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(SMALLEST)) <= RELATIVE)


def near_values(values: DataFrame, stated: DataFrame) -> DataFrame:
    """The distinct of the ``values`` (value) that are within 0.5 % of one of the ``stated`` (value).

    Each value looks into its own place and its two neighbours on a logarithmic scale, where all that
    is near lies (a pair with opposite signs is near only if both are tiny), and is then compared. So a
    value meets the few stated numbers around it, never all of them.
    """
    left = values.select("value").filter("value is not null").distinct().withColumn("at", _bin(F.col("value")))
    left = left.withColumn("at", F.explode(F.array(*(F.col("at") + i for i in (-1, 0, 1)))))
    right = stated.select(F.col("value").alias("other")).filter("other is not null").distinct().withColumn("at", _bin(F.col("other")))
    return left.join(right, "at").filter(near(F.col("value"), F.col("other"))).select("value").distinct()


def verify_numerals(tokens: DataFrame, stated: DataFrame, structural: DataFrame) -> DataFrame:
    """(id, total, unsupported, structural, pass_rate) of each text with numerals.

    A token passes if it is near a surface form of a ``stated`` number (value); else, counted apart, of a
    ``structural`` one; else if it is a percentage and its fraction is near a stated form, or isn't and
    its hundredfold is. tokens: as from ``numeral_tokens``. Distinct values are looked up, so a numeral that
    a third of all texts repeat is judged once.
    """
    forms = stated.select(F.explode(surface_forms(F.col("value").cast("double"))).alias("value"))
    frame = structural.select(F.explode(surface_forms(F.col("value").cast("double"))).alias("value"))
    other = F.when(F.col("percent"), F.col("value") / 100).otherwise(F.col("value") * 100)
    counted = tokens.groupBy("id", "value", "percent").agg(F.count("*").alias("n"))
    kinds = counted.select("value", "percent").distinct().withColumn("other", other)
    asked = kinds.select("value").unionByName(kinds.select(F.col("other").alias("value")))
    known = near_values(asked, forms).withColumn("known", F.lit(True))
    framed = near_values(kinds.select("value"), frame).withColumn("framed", F.lit(True))
    judged = kinds.join(known, "value", "left").join(framed, "value", "left").join(known.select(F.col("value").alias("other"), F.col("known").alias("scaled")), "other", "left")
    verdict = F.when(F.col("known"), "stated").when(F.col("framed"), "structural").when(F.col("scaled"), "stated").otherwise("unsupported")
    met = counted.join(judged.select("value", "percent", verdict.alias("verdict")), ["value", "percent"])
    of = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0))
    out = met.groupBy("id").agg(F.sum("n").alias("total"), of("unsupported").alias("unsupported"), of("structural").alias("structural"))
    return out.withColumn("pass_rate", 1 - F.col("unsupported") / F.col("total"))


# Words before a figure, sentence ends, reach of a citation in characters, and tolerances of its figures.
FIGURES = {"distance": r"距离|distance", "ret": r"录得|forward\s*return|realised\s*return|realized\s*return|actual\s*return|returned|收益(?:为|是|达|\s*为|\s*是|\s*达)", "mae": r"最大不利|max(?:imum)?\s*adverse|\bMAE\b", "mfe": r"最大有利|max(?:imum)?\s*favou?rable|\bMFE\b"}
DATE = r"\d{4}-\d{2}-\d{2}"
SENTENCE = r"(?s)^(.*?)(?:[。！？!?\n]|\.\s+[A-Z\"'(]|$)"
AHEAD, BEHIND = 140, 80
TOLERANCE = {"distance": 0.002, "ret": 0.03, "mae": 0.03, "mfe": 0.03}


def citations(texts: DataFrame, id_col: str, symbols: str, text_col: str = "text") -> DataFrame:
    """(id, place, date, symbol, distance, ret, mae, mfe): each ISO date of a text and the figures that its sentence cites after it.

    A figure is the first number after its word, between the date and the sentence's end, the next date or
    AHEAD characters; its digits are read whole. symbol is the last match of the pattern ``symbols``
    in the BEHIND characters before the date, from the sentence's start or the date before. Code spans are skipped.
    """
    text = F.regexp_replace(F.col(text_col).cast("string"), r"`[^`]*`", " ")
    read = texts.select(F.col(id_col).alias("id"), F.split(text, DATE).alias("pieces"), F.regexp_extract_all(text, F.lit(DATE), F.lit(0)).alias("dates"))
    each = read.select("id", "pieces", F.posexplode("dates").alias("place", "date"))
    each = each.select("id", "place", "date", F.substring(F.regexp_extract(F.get("pieces", F.col("place") + 1), SENTENCE, 1), 1, AHEAD).alias("ahead"), F.right(F.get("pieces", F.col("place")), F.lit(BEHIND)).alias("behind"))
    behind = F.regexp_replace("behind", r"(?s)^.*(?:[。！？!?\n]|\.\s+(?=[A-Z\"'(]))", "")
    number = lambda word: F.nullif(F.replace(F.regexp_extract("ahead", rf"(?is)(?:{word}).*?(-?\d+(?:,\d{{3}})*(?:\.\d+)?)", 1), F.lit(","), F.lit("")), F.lit("")).cast("double")
    symbol = F.element_at(F.regexp_extract_all(behind, F.lit(symbols), F.lit(0)), -1)
    return each.select("id", "place", "date", F.when(F.size(F.regexp_extract_all(behind, F.lit(symbols), F.lit(0))) > 0, symbol).alias("symbol"), *(number(w).alias(k) for k, w in FIGURES.items()))


def verify_citations(cited: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, place, date, verdict) of ``citations``, held against the rows (id, symbol, date, distance, ret, mae, mfe) of each id.

    unknown_date: none of the id's rows has the date. spliced: figures are cited, and no single row of the
    date (and symbol, if one is named) has them all within tolerance. explained: one has. date_only: no figure is cited.
    """
    own = rows.select("id", F.col("date").cast("string").alias("date"), F.col("symbol").alias("own_symbol"), *(F.col(k).alias(f"own_{k}") for k in FIGURES))
    fits = F.lit(True)
    for k, most in TOLERANCE.items():
        fits = fits & (F.col(k).isNull() | F.coalesce(F.abs(F.col(k) - F.col(f"own_{k}")) <= most, F.lit(False)))
    whole = fits & (F.col("symbol").isNull() | F.coalesce(F.col("symbol") == F.col("own_symbol"), F.lit(False)))
    met = cited.join(own.withColumn("there", F.lit(True)), ["id", "date"], "left").withColumn("whole", F.col("there") & whole)
    cites = sum((F.col(k).isNotNull().cast("int") for k in FIGURES), F.lit(0)) > 0
    judged = met.groupBy("id", "place", "date").agg(F.max("there").alias("there"), F.max("whole").alias("whole"), F.max(cites).alias("cites"))
    verdict = F.when(F.col("there").isNull(), "unknown_date").when(~F.col("cites"), "date_only").when(F.col("whole"), "explained").otherwise("spliced")
    return judged.select("id", "place", "date", verdict.alias("verdict"))
