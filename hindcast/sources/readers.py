"""Readers of the panel's raw inputs, with the rules for rows that are unusable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICE_SCHEMA = "entity string, session_date date, o double, h double, l double, c double, a double, v double"
SERIES_SCHEMA = "obs_date string, value string"


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from JSON lines; a row without a date or any price is dropped, missing volume stays null."""
    rows = spark.read.schema(PRICE_SCHEMA).json(path)
    return rows.dropna(subset=["entity", "session_date", "o", "h", "l", "c", "a"])


def read_series(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """(series_id, obs_date, value) of a two-column CSV with a header; '.' and empty values are dropped."""
    rows = spark.read.schema(SERIES_SCHEMA).option("header", True).csv(path)
    date, value = F.try_to_date("obs_date", "yyyy-MM-dd"), F.expr("try_cast(nullif(trim(value), '.') AS DOUBLE)")
    return rows.select(F.lit(series_id).alias("series_id"), date.alias("obs_date"), value.alias("value")).dropna()


def merge_pages(pages: DataFrame, key: str = "ts") -> DataFrame:
    """Rows of pages (page, ts, value) whose ranges overlap: of equal times the earliest page's row stays."""
    first = Window.partitionBy(key).orderBy("page", "value")
    return pages.filter(F.col(key).isNotNull()).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def daily_first(points: DataFrame) -> DataFrame:
    """(obs_date, value): the first point of each UTC day, of points (ts, value)."""
    good = points.filter("ts is not null and value is not null")
    return good.groupBy(F.to_date("ts").alias("obs_date")).agg(F.min_by("value", F.struct("ts", "value")).alias("value"))


def weekday_dates(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct dates (yyyymmdd in link names) of HTML pages that fall on weekdays."""
    found = pages.select(F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"monetary(\d{8})"), F.lit(1))).alias("d"))
    dates = found.select(F.try_to_date("d", "yyyyMMdd").alias("event_date")).filter("event_date is not null")
    return dates.filter(F.weekday("event_date") < 5).distinct()


def first_source(preferred: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """All rows of ``preferred``, and those of ``fallback`` for keys that ``preferred`` lacks altogether."""
    lacking = fallback.join(preferred.select(key).distinct(), key, "left_anti")
    return preferred.unionByName(lacking.select(*preferred.columns))
