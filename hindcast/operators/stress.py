"""Named scenarios, path fans, worst windows and composition with closed-market blocks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MIN_HISTORY
from .standardise import clip


@dataclass(frozen=True)
class Scenario:
    id: str
    kind: str
    date_from: str | None = None
    date_to: str | None = None
    z: dict[str, float] = field(default_factory=dict)
    raw: dict[str, float] = field(default_factory=dict)


# The registry of scenarios (windows by date, shocks in z or raw units, one composed with a venue's blocks).
SCENARIOS = [
    Scenario("covid-crash", "window", "2020-02-19", "2020-03-23"),
    Scenario("fed-tightening-2018", "window", "2018-10-01", "2018-12-24"),
    Scenario("rate-shock-2022", "window", "2022-01-03", "2022-10-12"),
    Scenario("regional-banks-2023", "window", "2023-03-08", "2023-03-31"),
    Scenario("carry-unwind-2024", "window", "2024-07-11", "2024-08-05"),
    Scenario("tariff-shock-2025", "window", "2025-03-24", "2025-04-09"),
    Scenario("vol-spike", "shock", z={"vix": 2.0, "vix_chg5": 1.5, "mkt_vol20": 1.0}),
    Scenario("rates-up", "shock", z={"d_rate90": 1.5, "slope": -1.0, "bei_chg20": 0.5}),
    Scenario("liquidity-air-pocket", "shock", z={"vix": 1.5, "mkt_vol20": 1.5, "mkt_ret20": -1.5, "gap20": 1.0}),
    Scenario("earnings-day", "shock", z={"event_load5": 1.0}, raw={"dte": 0.0}),
    Scenario("fomc-day", "shock", z={"event_load5": 1.0}, raw={"is_fomc_day": 1.0}),
    Scenario("crypto-contagion", "shock", z={"btc_ret5": -2.0, "btc_ret20": -1.5}),
    Scenario("china-adr-shock", "shock", z={"rel_bench20": -1.5, "usd_chg20": 1.0, "mkt_ret20": -0.5}),
    Scenario("weekend-hold-7x24", "venue"),
]


def scenario_spans(calendar: DataFrame, q: int, horizon: int, scenarios: list[Scenario], years_back: int = 0) -> DataFrame:
    """(query_id, scenario, skipped, j_low, j_high): the sessions that each scenario may see, from one pass over the calendar.

    A window's limit that no session meets is ignored. A window is skipped if its end, the first session
    on or after its last date, is later than ``horizon`` sessions before q. years_back moves the windows.
    """
    day = lambda d: F.add_months(F.lit(d).cast("date"), -12 * years_back)
    idx, date, none = F.col("session_idx"), F.col("session_date"), F.lit(None).cast("int")
    each = []
    for i, s in enumerate(scenarios):
        dated = s.date_from is not None
        first, last = (F.min(F.when(date >= day(s.date_from), idx)), F.max(F.when(date <= day(s.date_to), idx))) if dated else (none, none)
        end = F.min(F.when(date >= day(s.date_to), idx)) if dated else none
        each.append(F.struct(F.lit(i).cast("long").alias("query_id"), F.lit(s.id).alias("scenario"), first.alias("first"), last.alias("last"), end.alias("end")))
    spans = calendar.agg(F.array(*each).alias("s")).select(F.inline("s"))
    low, high = F.greatest(F.lit(MIN_HISTORY), F.col("first")), F.least(F.lit(q - horizon), F.col("last"))  # both skip nulls
    return spans.select("query_id", "scenario", F.coalesce(F.col("end") > q - horizon, F.lit(False)).alias("skipped"), low.alias("j_low"), high.alias("j_high"))


def scenario_queries(query_z: DataFrame, stats: DataFrame, spans: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """(query_id, feature, z, j_low, j_high): one state under every scenario that isn't skipped, as rows of one retrieval.

    query_z: (feature, z); stats: (feature, mu, sd) at its session. A raw value is standardised and
    replaces the feature; a shift is added to it, to 0 where it is missing; both are clipped.
    """
    moved = [(i, f, s.z.get(f), s.raw.get(f)) for i, s in enumerate(scenarios) for f in sorted({**s.z, **s.raw})]
    moves = query_z.sparkSession.createDataFrame(moved, "query_id long, feature string, dz double, raw double")
    base = stats.join(query_z, "feature", "left").withColumn("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(scenarios) - 1).cast("long"))))
    met = base.join(F.broadcast(moves), ["query_id", "feature"], "left")  # the registry: a few rows a scenario
    replaced = F.when(F.col("raw").isNotNull(), clip((F.col("raw") - F.col("mu")) / F.col("sd"))).otherwise(F.col("z").cast("double"))
    shifted = F.when(F.col("dz").isNotNull(), clip(F.coalesce("replaced", F.lit(0.0)) + F.col("dz"))).otherwise(F.col("replaced"))
    out = met.withColumn("replaced", replaced).withColumn("z", shifted).filter("z is not null")
    return out.join(F.broadcast(spans.filter("not skipped")), "query_id").select("query_id", "feature", "z", "j_low", "j_high")


def scenario_report(spans: DataFrame, states: DataFrame, fwd: str, digits: int = 4) -> DataFrame:
    """A row for each scenario: what followed its chosen states, and how its rounded figures differ from the first's.

    states: (query_id, fwd, mae) of chosen states. A scenario without states has n 0 and nulls.
    """
    held = lambda c: F.round(c, digits)
    q, m = F.percentile(fwd, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))), F.percentile("mae", 0.5)
    found = states.groupBy("query_id").agg(F.count(fwd).alias("n"), q.alias("q"), m.alias("mae"), F.avg((F.col(fwd) > 0).cast("int")).alias("up"))
    figures = {"p10": held(F.col("q")[0]), "median": held(F.col("q")[1]), "p90": held(F.col("q")[2]), "p_up": held("up"), "mae_median": held("mae")}
    rows = spans.join(found, "query_id", "left").select("query_id", "scenario", "skipped", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *(c.alias(name) for name, c in figures.items()))
    first = F.first(F.struct(*figures)).over(Window.orderBy("query_id"))  # a row for each scenario of the registry
    rows = rows.withColumn("base", first)
    return rows.select("scenario", "skipped", "n", *figures, *(held(F.col(name) - F.col("base")[name]).alias(f"d_{name}") for name in ("p10", "median", "mae_median")))


def path_fan(chosen: DataFrame, grid: DataFrame, horizon: int, levels=(0.10, 0.25, 0.50, 0.75, 0.90)) -> DataFrame:
    """(query_id, t, n, p<level>...): percentiles of the chosen states' paths at each step ahead."""
    steps = chosen.select("query_id", "entity", "session_idx", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("t"))
    close = grid.select("entity", F.col("session_idx").alias("at"), F.col("a").alias("p")).filter("p > 0")
    entry = close.select("entity", F.col("at").alias("session_idx"), F.col("p").alias("p0"))
    met = steps.join(entry, ["entity", "session_idx"]).withColumn("at", F.col("session_idx") + F.col("t")).join(close, ["entity", "at"])
    q = F.percentile(F.col("p") / F.col("p0") - 1, F.array(*map(F.lit, levels)))
    out = met.groupBy("query_id", "t").agg(F.count("*").alias("n"), q.alias("q"))
    return out.select("query_id", "t", "n", *(F.col("q")[i].alias(f"p{round(v * 100)}") for i, v in enumerate(levels)))


def worst_windows(grid: DataFrame, benchmark: Column, horizon: int, top: int, gap: int) -> DataFrame:
    """(j, ret): the benchmark's worst returns over ``horizon`` sessions, none within ``gap`` of a worse one kept."""
    by = Window.partitionBy("entity").orderBy("session_idx")
    rows = grid.filter(F.col("entity") == benchmark).select(F.col("session_idx").alias("j"), F.when(F.col("a") > 0, F.lead("a", horizon).over(by) / F.col("a") - 1).alias("ret")).filter("ret is not null")
    kind = "array<struct<ret:double,j:int>>"

    def step(kept: Column, r: Column) -> Column:
        clash = F.exists(kept, lambda o: F.abs(o["j"] - r["j"]) < gap)
        return F.when((F.size(kept) < top) & ~clash, F.array_append(kept, r)).otherwise(kept)

    # One entity's calendar: as many rows as there are sessions.
    folded = rows.agg(F.sort_array(F.collect_list(F.struct("ret", F.col("j").cast("int").alias("j")))).alias("all"))
    return folded.select(F.explode(F.aggregate("all", F.array().cast(kind), step)).alias("o")).select("o.j", "o.ret")


def compose_blocks(chosen: DataFrame, blocks: DataFrame, fwd: str) -> DataFrame:
    """Each chosen state's path after a closed-market block: (query_id, entity, session_idx, block_no, fwd, mae, mfe).

    State n of a query (by rn) takes block (n - 1) mod B; a state without outcome keeps its turn.
    blocks: (block_no from 0, return_pct, mae_pct, mfe_pct), a venue's measured blocks, few.
    """
    numbered = chosen.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rn")) - 1)
    size = blocks.agg(F.count("*").alias("b"))
    met = numbered.crossJoin(F.broadcast(size)).withColumn("block_no", F.expr("CAST(n % b AS INT)")).filter(F.col(fwd).isNotNull() & F.col("mae").isNotNull())
    met = met.drop("b").withColumnsRenamed({"mae": "own_mae", "mfe": "own_mfe"}).join(F.broadcast(blocks), "block_no").filter("return_pct is not null and mae_pct is not null")
    level = 1 + F.col("return_pct") / 100
    return met.select(
        "query_id", "entity", "session_idx", "block_no", (level * (1 + F.col(fwd)) - 1).alias("fwd"), F.least(F.col("mae_pct") / 100, level * (1 + F.col("own_mae")) - 1).alias("mae"),
        F.greatest(F.coalesce("mfe_pct", F.lit(0.0)) / 100, level * (1 + F.coalesce("own_mfe", F.lit(0.0))) - 1).alias("mfe"),
    )
