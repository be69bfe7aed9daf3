"""The driver's tables as a panel: entities, sessions, bars, series, events and candles."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, panel, standardise
from ..schema import METRIC
from .staging import print_of, staged

#: Levels by the series that stands for each.
SERIES = {"vix": "p:1-URGENT", "slope": "p:2-HIGH", "fed": "p:3-MEDIUM", "bei": "p:4-NOT SPECIFIED", "usd": "p:5-LOW", "oil": "s:F", "hy": "s:O", "btc": "s:P", "fng": "all"}


class Panel:
    """Tables derived from ``sf_dir``; a ``grain`` of week or day sets the session.

    Bars, features and z-scores, which many steps read, are staged when first asked for. ``Panel.of`` gives
    all queries of a session over the same files one panel, so that they are built once for all.
    """

    _known: dict[tuple, Panel] = {}

    def __init__(self, spark: SparkSession, sf_dir: str, grain: str = "week"):
        self.spark, self.sf_dir, self.grain = spark, sf_dir, grain
        self._made: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, grain: str = "week") -> Panel:
        """The session's panel over these files; a new one as soon as any of them has changed."""
        key = (spark.sparkContext.applicationId, sf_dir, grain, print_of(spark, [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part", "orders", "events")]))
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir, grain)
        return cls._known[key]

    def once(self, name: str, make: Callable[[Panel], DataFrame]) -> DataFrame:
        """A further table of the panel, staged when first asked for."""
        if name not in self._made:
            self._made[name] = staged(make(self), name)
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def bars(self) -> DataFrame:
        """Unit prices of a brand by session: first, highest, lowest and last; ``a`` is net of discount."""
        lines = self.table("lineitem").select("l_partkey", "l_quantity", "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("u"), "l_discount")
        own = lines.join(self.table("part").select("p_partkey", F.col("p_brand").alias("entity")), F.col("l_partkey") == F.col("p_partkey"))
        own = own.withColumns({"session_date": F.date_trunc(self.grain, "l_shipdate").cast("date"), "k": F.struct("l_shipdate", "l_orderkey", "l_linenumber"), "net": F.col("u") * (1 - F.col("l_discount"))})
        made = own.groupBy("entity", "session_date").agg(
            F.min_by("u", "k").alias("o"), F.max("u").alias("h"), F.min("u").alias("l"), F.max_by("u", "k").alias("c"), F.max_by("net", "k").alias("a"), F.sum("l_quantity").alias("v")
        )
        return staged(made, "bars")

    @cached_property
    def names(self) -> tuple[str, str]:
        """The first and second entity in sort order: benchmark and growth."""
        first = self.table("part").select("p_brand").distinct().orderBy("p_brand").limit(2).collect()
        return first[0][0], first[-1][0]

    @property
    def benchmark(self):
        return F.lit(self.names[0])

    @cached_property
    def calendar(self) -> DataFrame:
        return panel.sessions(self.bars, self.benchmark)

    @cached_property
    def grid(self) -> DataFrame:
        return panel.align(self.bars, self.calendar)

    @cached_property
    def series(self) -> DataFrame:
        """Monthly mean order values by priority, by status and of all, at the month's last order."""
        o = self.table("orders").select("o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice")
        each = o.select(F.explode(F.array(F.concat(F.lit("p:"), "o_orderpriority"), F.concat(F.lit("s:"), "o_orderstatus"), F.lit("all"))).alias("series_id"), "o_orderdate", "o_totalprice")
        return each.groupBy("series_id", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.max("o_orderdate").cast("date").alias("obs_date"), F.avg("o_totalprice").alias("value")).drop("month")

    @cached_property
    def levels(self) -> DataFrame:
        carried = panel.asof(self.calendar, self.series)
        return carried.groupBy("session_idx").agg(*(F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(name) for name, s in SERIES.items()))

    @cached_property
    def entity_events(self) -> DataFrame:
        """(entity, event_date): the first session of each entity and quarter."""
        return self.bars.groupBy("entity", F.date_trunc("quarter", "session_date").alias("quarter")).agg(F.min("session_date").alias("event_date")).drop("quarter")

    @cached_property
    def market_events(self) -> DataFrame:
        """(event_date): sessions that hold the first day of a month."""
        ends = self.calendar.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
        months = ends.select(F.explode(F.sequence(F.date_trunc("month", "a").cast("date"), F.date_add("b", 6), F.expr("INTERVAL 1 MONTH"))).alias("d"))
        return months.select(F.date_trunc(self.grain, "d").cast("date").alias("event_date")).distinct()

    @cached_property
    def features(self) -> DataFrame:
        snapped = panel.next_session(self.calendar, self.entity_events)
        market = self.market_events.join(self.calendar, F.col("event_date") == F.col("session_date")).select("session_idx")
        return staged(features.feature_panel(self.grid, self.levels, snapped, market, self.benchmark, F.lit(self.names[1])), "features")

    @cached_property
    def session_stats(self) -> DataFrame:
        return staged(standardise.session_stats(self.features, self.calendar), "stats")

    @property
    def stats(self) -> DataFrame:
        return standardise.expanding_stats(self.session_stats)

    @cached_property
    def z_rows(self) -> DataFrame:
        return staged(standardise.z_rows(self.features, self.session_stats), "z")

    @property
    def z(self) -> DataFrame:
        return standardise.z_scores(self.z_rows)

    @property
    def vectors(self) -> DataFrame:
        return standardise.z_vectors(self.z_rows, METRIC)

    @cached_property
    def hourly(self) -> DataFrame:
        from ..operators import closed

        return closed.candles(self.table("events").select(F.col("event_type").alias("instrument"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), "value"))
